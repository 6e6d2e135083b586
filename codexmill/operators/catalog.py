"""Relational operators of the catalog: current rows, shelf views, duplicates, tags, progress, jobs, sessions.

Every function takes DataFrames and returns DataFrames; keys that may be hot (one user, one folder) are aggregated
partially before their shuffle, and no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.operators.skew import previous, running_sum, sorted_fold

# Reading states, job states, palette size and limits of the catalog.
READING = ("unread", "reading", "finished", "paused")
OPEN_JOBS = ("queued", "running")
CONTINUE_LIMIT = 5


def current_books(books: DataFrame) -> DataFrame:
    """The latest scan of each book; later scans win by (scanned_at, file_mtime), plain copies collapse."""
    cols = [c for c in books.columns if c != "id"]
    best = F.max_by(F.struct(*cols), F.struct("scanned_at", "file_mtime", "reading_status"))
    return books.groupBy("id").agg(best.alias("b")).select("id", "b.*")


def upsert_books(current: DataFrame, scanned: DataFrame, now: int) -> DataFrame:
    """Upsert by path: source columns come from the scan, the reader's own columns stay; new paths get defaults."""
    source = ["folder_id", "source_path", "format", "encoding", "size_bytes", "char_count", "chapter_count", "file_mtime", "file_hash"]
    own = [c for c in current.columns if c not in {"path", *source, "scanned_at"}]
    s = scanned.select("path", F.struct(*source, "title", "author").alias("s"))
    c = current.select("path", F.struct(*[x for x in current.columns if x != "path"]).alias("c"))
    j = c.join(s, "path", "full_outer")
    old = F.col("c").isNotNull()
    new_values = {"added_at": F.lit(now), "title": F.col("s.title"), "author": F.col("s.author"), "favorite": F.lit(False), "has_cover": F.lit(False), "reading_status": F.lit("unread")}
    cols: list[Column] = []
    for x in current.columns:
        if x == "path":
            cols.append(F.col("path"))
        elif x in source:
            cols.append(F.when(F.col("s").isNotNull(), F.col(f"s.{x}")).otherwise(F.col(f"c.{x}")).alias(x))
        elif x == "scanned_at":
            cols.append(F.when(F.col("s").isNotNull(), F.lit(now)).otherwise(F.col("c.scanned_at")).alias(x))
        elif x in own:
            cols.append(F.when(old, F.col(f"c.{x}")).otherwise(new_values.get(x, F.lit(None))).alias(x))
    return j.select(*cols)


def update_books(books: DataFrame, changes: DataFrame) -> DataFrame:
    """Partial update by id: a null keeps the value, texts are trimmed, '' becomes null; a title cannot be emptied."""
    cols = [c for c in changes.columns if c != "id"]
    j = books.join(changes.select("id", *[F.col(c).alias(f"_{c}") for c in cols]), "id", "left")
    for c in cols:
        new = F.when(F.col(f"_{c}").isNull(), F.col(c))
        new = new.otherwise(F.coalesce(F.nullif(F.trim(f"_{c}"), F.lit("")), F.col("title")) if c == "title" else F.nullif(F.trim(f"_{c}"), F.lit("")))
        j = j.withColumn(c, new)
    return j.select(*books.columns)


def folder_counts(folders: DataFrame, books: DataFrame) -> DataFrame:
    """Each folder with its number of books, 0 where it has none."""
    n = books.groupBy("folder_id").agg(F.count("*").alias("n_books"))
    return folders.join(n, folders.id == n.folder_id, "left").select("id", "path", F.coalesce("n_books", F.lit(0)).alias("n_books"))


def duplicate_groups(books: DataFrame) -> DataFrame:
    """File hashes of more than one book, with their numbers; null and '' are no hash."""
    return books.where("file_hash is not null and file_hash <> ''").groupBy("file_hash").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_members(books: DataFrame) -> DataFrame:
    """The books of the duplicate groups; the groups are joined back, so that no group sits in one task."""
    g = duplicate_groups(books)
    return books.join(g, "file_hash").select("file_hash", "n", "id", "title")


def ascii_lower(c: Column) -> Column:
    """Lower case of ASCII letters only, as orders of names have it."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def public_message(c: Column) -> Column:
    """A message without the folders of the paths in it."""
    return F.trim(F.regexp_replace(F.trim(c), r"(?:[A-Za-z]:)?(?:[\\/][^\\/\s:]+)*[\\/]", ""))


def tags_of(books: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags, book_tags) from the books' category and format."""
    pairs = books.select(F.col("id").alias("book_id"), F.explode(F.array("category", "format")).alias("name")).where("name is not null and trim(name) <> ''").select("book_id", F.trim("name").alias("name")).distinct()
    return pairs.select("name").distinct(), pairs


def add_tags(book_tags: DataFrame, book_ids: DataFrame, names: list[str]) -> DataFrame:
    """Insert-or-ignore of every given tag on every given book; names are trimmed and distinct."""
    clean = sorted({n.strip() for n in names if n.strip()})
    new = book_ids.select("book_id", F.explode(F.array(*[F.lit(n) for n in clean]) if clean else F.array().cast("array<string>")).alias("name"))
    return book_tags.unionByName(new.join(book_tags, ["book_id", "name"], "left_anti")).distinct()


def remove_tags(book_tags: DataFrame, book_ids: DataFrame, names: list[str]) -> DataFrame:
    """Without the given tags on the given books."""
    gone = book_tags.where(F.col("name").isin(names)).join(book_ids.select("book_id").distinct(), "book_id", "left_semi")
    return book_tags.join(gone, ["book_id", "name"], "left_anti")


def tag_lists(books: DataFrame, book_tags: DataFrame) -> DataFrame:
    """Every book with the sorted array of its tags (ASCII case ignored in the order)."""
    t = book_tags.groupBy("book_id").agg(F.sort_array(F.collect_set(F.struct(F.lower("name").alias("k"), "name"))).alias("t"))
    return books.join(t, books.id == t.book_id, "left").select("id", F.coalesce(F.transform("t", lambda x: x["name"]), F.array().cast("array<string>")).alias("tags"))


def shelf(books: DataFrame, book_tags: DataFrame, query: str = "", status: str | None = None, favorite: bool = False, tag: str | None = None) -> DataFrame:
    """The shelf's filter: a substring of title, author, category or a tag (case ignored), a status, favourites, a tag."""
    out = books
    if query:
        q = query.lower()
        hit = book_tags.where(F.lower("name").contains(q)).select(F.col("book_id").alias("id")).distinct().withColumn("by_tag", F.lit(True))
        own = F.lower("title").contains(q) | F.coalesce(F.lower("author").contains(q), F.lit(False)) | F.coalesce(F.lower("category").contains(q), F.lit(False))
        out = out.join(hit, "id", "left").where(own | F.coalesce("by_tag", F.lit(False))).drop("by_tag")
    if status:
        out = out.where(F.col("reading_status") == status)
    if favorite:
        out = out.where("favorite")
    if tag:
        out = out.join(book_tags.where(F.col("name") == tag).select(F.col("book_id").alias("id")).distinct(), "id", "left_semi")
    return out


def prune_missing(books: DataFrame, folder_id: int, present: DataFrame) -> DataFrame:
    """Books that stay after a scan: of other folders, or whose path is present."""
    return books.where(F.col("folder_id") != folder_id).unionByName(books.where(F.col("folder_id") == folder_id).join(present.select("path"), "path", "left_semi").select(books.columns))


def progress_latest(log: DataFrame) -> DataFrame:
    """The newest write of each (user, book), whatever the order of arrival; ties by position."""
    best = F.max_by(F.struct("char_offset", "chapter_idx", "chapter_offset", "updated_at"), F.struct("updated_at", "char_offset", "chapter_idx", "chapter_offset"))
    return log.groupBy("user_id", "book_id").agg(best.alias("p")).select("user_id", "book_id", "p.*")


def at_book_end(offset: Column, n: Column, fmt: Column) -> Column:
    """Whether a position is at the end of a book: the last page, or within a hundredth (1000 to 3000 characters) of the end."""
    slack = F.greatest(F.lit(1000), F.least(F.lit(3000), (n / 100).cast("long")))
    return F.when(n.isNull() | (n <= 0), F.lit(False)).when(fmt == "pdf-image", offset >= n - 1).otherwise(offset >= n - slack)


def reading_status(latest: DataFrame, books: DataFrame) -> DataFrame:
    """States that the reading positions bring about: unread to reading to finished; paused and finished stay."""
    seen = latest.join(books.select(F.col("id").alias("book_id"), "char_count", "format", "reading_status"), "book_id")
    end = seen.groupBy("book_id").agg(F.max(at_book_end(F.col("char_offset"), F.col("char_count"), F.col("format")).cast("int")).alias("ended"))
    j = books.join(end, books.id == end.book_id, "left")
    s = F.col("reading_status")
    new = F.when(s.isin("finished", "paused") | F.col("ended").isNull(), s).when(F.col("ended") == 1, "finished").when(s == "unread", "reading").otherwise(s)
    return j.select("id", new.alias("reading_status"))


def recent_shelf(books: DataFrame, latest: DataFrame, user_id: str) -> DataFrame:
    """Books with the user's last position, 0 where there is none."""
    p = latest.where(F.col("user_id") == user_id).select("book_id", F.col("updated_at").alias("read_at"))
    return books.join(p, books.id == p.book_id, "left").select("id", "title", F.coalesce("read_at", F.lit(0)).alias("read_at"), "scanned_at")


def attempt(state: tuple[int, int, int, bool], t: int, ok: bool, gap: int, limit: int) -> tuple[tuple[int, int, int, bool], tuple | None]:
    """One attempt against (failures, first, last, open): (new state, the session that ended by it or None).

    An attempt while blocked, successful or not, does not count; a gap or a success ends a session."""
    n, first, last, _ = state
    if n and t > last + gap:
        done, n = (first, last, n, n >= limit), 0
    else:
        done = None
        if n >= limit:
            return state, None
    if ok:
        return (0, 0, 0, False), done or ((first, last, n, False) if n else None)
    return (n + 1, t if n == 0 else first, t, True), done


def throttle(events: DataFrame, gap: int = 60, limit: int = 5) -> DataFrame:
    """Sessions of failures per key (key, t, ok): blocked from the limit-th failure until `gap` seconds after it.

    What lies more than a gap apart is independent, so a key's attempts are cut at such gaps first, by days that are
    counted apart, and each stretch is folded on its own. Rows that are equal in t and ok are alike."""
    rows = previous(events.withColumn("day", F.floor(F.col("t") / 86_400)), "key", "day", ["t", "ok"], ["t", "ok"])
    prev = F.col("prev")
    rows = rows.withColumn("starts", (prev.isNull() | (F.col("t") - prev["t"] > gap)).cast("int"))
    rows = running_sum(rows, "key", "day", ["t", "ok"], F.col("starts")).withColumn("stretch", F.col("before") + F.col("starts"))

    def step(state, row):
        state, done = attempt(state, int(row.t), bool(row.ok), gap, limit)
        return state, [done] if done else []

    def end(state):
        n, first, last, _ = state
        return [(first, last, n, n >= limit)] if n else []

    kind = events.schema["key"].dataType.simpleString()
    got = sorted_fold(rows.select("key", "stretch", "t", "ok"), ["key", "stretch"], ["t", "ok"], lambda: (0, 0, 0, False), step, end, f"key {kind}, stretch long, first_t long, last_t long, failures long, blocked boolean")
    return got.drop("stretch")


def paced(reports: DataFrame, wait: int = 200) -> DataFrame:
    """Progress reports of jobs (job_id, t in milliseconds, done, total) that are written: the first, those at least `wait` after the last written one, and the final one."""

    def step(last, row):
        keep = last is None or row.t - last >= wait or row.done == row.total
        return (int(row.t), [(int(row.t), int(row.done), int(row.total))]) if keep else (last, [])

    return sorted_fold(reports.select("job_id", "t", "done", "total"), ["job_id"], ["t", "done"], lambda: None, step, lambda _: [], "job_id long, t long, done long, total long")


def live_sessions(sessions: DataFrame, users: DataFrame, now: int) -> DataFrame:
    """Sessions that have not expired, with their users."""
    return sessions.where(F.col("expires_at") > now).join(users, "user_id").select("token", "user_id", "role", "expires_at")


def delete_folder(folder_id: int, folders: DataFrame, books: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Cascading delete: folder, its books, and what belongs to them (children have book_id)."""
    gone = books.where(F.col("folder_id") == folder_id).select(F.col("id").alias("book_id")).distinct()
    return folders.where(F.col("id") != folder_id), books.where(F.col("folder_id") != folder_id), {k: d.join(gone, "book_id", "left_anti") for k, d in children.items()}


def delete_user(user_id: str, users: DataFrame, children: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Delete of a user with all their rows; the last admin stays."""
    others = users.where((F.col("role") == "admin") & (F.col("user_id") != user_id)).agg(F.count("*").alias("others"))
    kept = users.crossJoin(F.broadcast(others)).where((F.col("user_id") != user_id) | ((F.col("role") == "admin") & (F.col("others") == 0))).drop("others")
    gone = users.where(F.col("user_id") == user_id).select("user_id").join(kept, "user_id", "left_anti")
    return kept, {k: d.join(gone, "user_id", "left_anti") for k, d in children.items()}


def adopt(rows: DataFrame, new_user: str, old_user: str = "default") -> DataFrame:
    """Rows of the legacy user go over to a new one."""
    return rows.withColumn("user_id", F.when(F.col("user_id") == old_user, F.lit(new_user)).otherwise(F.col("user_id")))


def fail_stale_jobs(jobs: DataFrame, now: int) -> DataFrame:
    """Open jobs become failed, as at a restart; their phase and detail are cleared."""
    stale = F.col("status").isin(*OPEN_JOBS)
    return jobs.withColumns({"finished_at": F.when(stale, F.lit(now)).otherwise(F.col("finished_at")), "error": F.when(stale, F.lit("interrupted")).otherwise(F.col("error")), "status": F.when(stale, F.lit("failed")).otherwise(F.col("status"))})


def job_rollup(jobs: DataFrame) -> DataFrame:
    """Sums over the parts of a job, with all failures; the total is the number of folders."""
    return jobs.groupBy("job_id").agg(F.count_distinct("folder_id").alias("total"), F.sum("added").alias("added"), F.sum("updated").alias("updated"), F.sum("removed").alias("removed"), F.sort_array(F.flatten(F.collect_list("failures"))).alias("failures"))


def evolve(df: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Additive schema change: columns that are missing come with their default."""
    for name, (kind, default) in wanted.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(default).cast(kind))
    return df


def merge_progress(log: DataFrame) -> DataFrame:
    """Optimistic writes applied in order of arrival for each (user, book): a write whose base is older than the stored version is refused.

    Input (user_id, book_id, seq, base, updated_at, char_offset), with `legacy`, the version that older clients send, if
    there is such a column; a base that is null or 0 gives way to it, and without either a write always wins. Gives the
    last accepted write and the number of refused ones. A fold over the writes of one user to one book, in the JVM."""
    legacy = F.col("legacy") if "legacy" in log.columns else F.lit(None).cast("long")
    base = F.coalesce(F.nullif("base", F.lit(0)), legacy, F.lit(0)).alias("base")
    rows = log.groupBy("user_id", "book_id").agg(F.sort_array(F.collect_list(F.struct("seq", base, "updated_at", "char_offset"))).alias("w"))
    start = F.struct(F.lit(0).cast("long").alias("version"), F.lit(None).cast("long").alias("char_offset"), F.lit(0).cast("long").alias("refused"))

    def step(acc, x):
        ok = (x["base"] == 0) | (acc["version"] <= x["base"])
        return F.struct(F.when(ok, x["updated_at"]).otherwise(acc["version"]).alias("version"), F.when(ok, x["char_offset"]).otherwise(acc["char_offset"]).alias("char_offset"), (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"))

    return rows.select("user_id", "book_id", F.aggregate("w", start, step).alias("r")).select("user_id", "book_id", "r.*")
