"""Chapter structure: rules over lines, their scores, selection, depth, and removal of an embedded contents list.

All of it is windows and aggregates keyed by book; a book's lines are never gathered in one Python call.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import text as T
from codexmill.operators.clean import lines
from codexmill.session import materialise

# Numerals, units and names that chapter headings are made of, and the selection's limits.
NUMERAL = r"[0-9零〇一二三四五六七八九十百千万]"
BRACKETED = r"[「『【〈\[（(]\s*" + NUMERAL + r"+\s*[」』】〉\]）)]"
NAMED = ("楔子", "序章", "序言", "序篇", "引子", "前言", "尾声", "后记", "番外", "终章", "结语")
MIN_OF_RANK = {0: 2, 1: 2, 2: 1}
DOMINANCE, LEAF, MIN_LEAVES, MIN_LOOSE = 0.5, 2, 3, 2
HOLLOW, MIN_RUN, MAX_HOLLOW = 40, 4, 0.8
SYNTHETIC = "正文"


@dataclass(frozen=True)
class Rule:
    """A heading's shape on a trimmed line (group 1 is the title), its rank, whether it is trusted, its least number."""

    name: str
    rank: int
    pattern: str
    trusted: bool = False
    least: int = 1


def _unit(name: str, unit: str) -> Rule:
    return Rule(name, 2, rf"^(第\s*{NUMERAL}+\s*{unit}(?:[^\r\n。「」]{{0,11}}（[^）\r\n]{{1,6}}）|[^\r\n。「」]{{0,10}}))\z")


RULES = (
    Rule("part", 0, rf"^(第\s*{NUMERAL}+\s*部[^\r\n]{{0,30}})\z"),
    Rule("volume", 1, rf"^(第\s*{NUMERAL}+\s*卷[^\r\n]{{0,30}}|卷\s*{NUMERAL}+[^\r\n]{{0,30}})\z"),
    *(_unit(n, u) for n, u in (("zhang", "章"), ("jie", "节"), ("hui", "回"), ("zhe", "折"), ("pian", "篇"), ("ji", "集"))),
    Rule("english", 2, r"^((?:Chapter|CHAPTER)\s+[0-9]+[^\r\n]{0,30})\z"),
    Rule("named", 2, "^(" + "|".join(rf"{n[0]}[\s\p{{Zs}}]*{n[1]}" for n in NAMED) + r")[^\r\n]{0,40}\z", True),
    Rule("bracket", 2, rf"^({BRACKETED})\z", True),
    Rule("enum", 2, rf"^({NUMERAL}{{1,4}}\s*、\s*[^\r\n]{{1,30}})\z", False, 2),
    Rule("spaced", 2, rf"^({NUMERAL}{{1,4}}[ \t\p{{Zs}}]+[^\s\r\n][^\r\n]{{0,13}})\z", False, 3),
)
LOOSE = r"^([0-9]{1,4})\z"


def matches(texts: DataFrame, key: str, text: str, rules=RULES) -> DataFrame:
    """(key, line_no, offset, rule_no, title): each line with each rule that it matches."""
    rows = lines(texts, key, text).withColumn("t", T.btrim(F.col("line"))).where("t <> ''")
    cases = F.filter(F.array(*[F.when(F.col("t").rlike(r.pattern), F.struct(F.lit(i).alias("rule_no"), T.btrim(F.regexp_extract("t", r.pattern, 1)).alias("title"))) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    return rows.select(key, "line_no", "offset", F.explode(cases).alias("m")).select(key, "line_no", "offset", "m.rule_no", "m.title")


def scores(found: DataFrame, key: str) -> DataFrame:
    """(key, rule_no, n, ratio, score): how often a rule matches and how far its numbers go up by one."""
    rows = found.withColumn("number", T.chapter_number(F.col("title")))
    w = Window.partitionBy(key, "rule_no").orderBy("offset")
    steps = rows.where("number is not null").withColumn("prev", F.lag("number").over(w)).where("prev is not null").groupBy(key, "rule_no").agg(F.avg((F.col("number") == F.col("prev") + 1).cast("int")).alias("ratio"))
    n = rows.groupBy(key, "rule_no").agg(F.count("*").alias("n"))
    out = n.join(steps, [key, "rule_no"], "left").withColumn("ratio", F.coalesce("ratio", F.lit(1.0)))
    return out.withColumn("score", F.col("n") * (F.lit(0.3) + F.lit(0.7) * F.col("ratio")))


def kept_rules(scored: DataFrame, key: str, rules=RULES) -> DataFrame:
    """The rules that win: trusted ones, and those that reach half of the best score and the trusted count at their rank; ranks with too few headings go."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("rule_no") + 1)
    rows = scored.withColumns({"rank": at([r.rank for r in rules]), "trusted": at([r.trusted for r in rules]), "least": at([r.least for r in rules])})
    w = Window.partitionBy(key, "rank")
    rows = rows.withColumns({"best": F.max(F.when(~F.col("trusted"), F.col("score"))).over(w), "trust": F.sum(F.when(F.col("trusted"), F.col("n")).otherwise(0)).over(w)})
    keep = F.col("trusted") | ((F.col("n") >= F.col("least")) & (F.col("score") >= F.greatest(F.col("best") * DOMINANCE, F.col("trust"))))
    rows = rows.where(keep).withColumn("total", F.sum("n").over(w))
    least = F.element_at(F.create_map(*[F.lit(x) for kv in MIN_OF_RANK.items() for x in kv]), F.col("rank"))
    return rows.where(F.col("total") >= least).select(key, "rule_no", "rank")


def detect(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, idx, title, level, offset): the chapters of every text, at least one (a synthetic one at 0).

    One pass over the lines tries all rules, the loose one too; its matches are written once, being few."""
    every = materialise(matches(texts, key, text, (*RULES, Rule("loose", LEAF, LOOSE))), "headings")
    found = every.where(F.col("rule_no") < len(RULES))
    loose = every.where(F.col("rule_no") == len(RULES)).withColumn("rank", F.lit(LEAF)).select(key, "offset", "rule_no", "title", "rank")
    good = found.join(kept_rules(scores(found, key), key), [key, "rule_no"]).select(key, "offset", "rule_no", "title", "rank")

    def merged(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key, "offset").agg(F.min_by(F.struct("title", "rank"), "rule_no").alias("m")).select(key, "offset", "m.title", "m.rank")

    leaves = merged(good).where(F.col("rank") == LEAF).groupBy(key).agg(F.count("*").alias("leaves"))
    enough = loose.groupBy(key).agg(F.count("*").alias("n_loose")).where(F.col("n_loose") >= MIN_LOOSE)
    wanted = enough.join(leaves, key, "left").where(F.coalesce("leaves", F.lit(0)) < MIN_LEAVES).select(key)
    first = merged(good.unionByName(loose.join(wanted, key, "left_semi")))
    none = texts.select(key).join(first.select(key).distinct(), key, "left_anti").select(key, F.lit(0).cast("long").alias("offset"), F.lit(SYNTHETIC).alias("title"), F.lit(LEAF).alias("rank"))
    return depth(first.unionByName(none), key)


def by_pattern(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Chapters by one pattern of the caller's own (group 1, if there is one and it holds anything, is the title), all at level 0; a synthetic one where nothing matches."""
    t = F.col("t")
    rows = lines(texts, key, text).withColumn("t", T.btrim(F.col("line"))).where((t != "") & t.rlike(pattern))
    has_group = re.compile(pattern).groups > 0
    own = T.btrim(F.regexp_extract("t", pattern, 1)) if has_group else F.lit("")
    found = rows.select(key, F.coalesce(F.nullif(own, F.lit("")), t).alias("title"), "offset")
    none = texts.select(key).join(found.select(key).distinct(), key, "left_anti").select(key, F.lit(SYNTHETIC).alias("title"), F.lit(0).cast("long").alias("offset"))
    w = Window.partitionBy(key).orderBy("offset")
    return found.unionByName(none).select(key, F.row_number().over(w).cast("long").alias("idx"), "title", F.lit(0).alias("level"), "offset")


def depth(rows: DataFrame, key: str) -> DataFrame:
    """Ranks to levels: the number of wider headings that are still open, by the last places of ranks 0 and 1 before the row."""
    w = Window.partitionBy(key).orderBy("offset")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("idx", F.row_number().over(w).cast("long"))
    rows = rows.withColumns({"l0": F.coalesce(F.max(F.when(F.col("rank") == 0, F.col("idx"))).over(before), F.lit(-1)), "l1": F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("idx"))).over(before), F.lit(-1))})
    open0 = (F.col("l0") >= 0).cast("int")
    open1 = (F.col("l1") > F.col("l0")).cast("int")
    level = F.when(F.col("rank") == 0, 0).when(F.col("rank") == 1, open0).otherwise(open0 + open1)
    return rows.select(key, "idx", "title", level.alias("level"), "offset")


def contents_runs(chapters: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Chapters with `hollow` (hardly a body) and what becomes of them: keep, drop, or keep the heading alone (divider).

    Runs of at least MIN_RUN hollow chapters are a contents list, unless most chapters of the book are hollow; the last
    chapter of a run that is wider than its successor begins the real text and stays."""
    w = Window.partitionBy(key).orderBy("idx")
    ranges = chapters.withColumn("stop", F.lead("offset").over(w)).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "title", "level", "offset", "stop"))).alias("cs"))
    rows = texts.select(key, F.col(text).alias("_t")).join(ranges, key).select(key, "_t", F.explode("cs").alias("c")).select(key, "_t", "c.*")
    stop = F.coalesce("stop", F.length("_t").cast("long"))
    part = F.substring("_t", (F.col("offset") + 1).cast("int"), (stop - F.col("offset")).cast("int"))
    body = T.non_space(F.when(part.contains("\n"), F.regexp_extract(part, "(?s)^[^\\n]*\\n(.*)\\z", 1)).otherwise(F.lit("")))
    rows = rows.select(key, "idx", "title", "level", "offset", stop.alias("stop"), (body <= HOLLOW).alias("hollow"))
    book = Window.partitionBy(key)
    rows = rows.withColumns({"n": F.count("*").over(book), "n_hollow": F.sum(F.col("hollow").cast("int")).over(book), "island": F.row_number().over(w) - F.row_number().over(Window.partitionBy(key, "hollow").orderBy("idx"))})
    run = Window.partitionBy(key, "hollow", "island")
    rows = rows.withColumns({"run_n": F.count("*").over(run), "run_stop": F.max("stop").over(run), "next_level": F.lead("level").over(run.orderBy("idx"))})
    in_run = F.col("hollow") & (F.col("run_n") >= MIN_RUN) & (F.col("n") >= MIN_RUN) & (F.col("n_hollow") <= F.col("n") * MAX_HOLLOW)
    wider = F.max(F.when(F.col("level") < F.col("next_level"), F.col("idx"))).over(run)
    rows = rows.withColumn("fate", F.when(~in_run, "keep").when(F.col("idx") == wider, "divider").otherwise("drop"))
    return rows.select(key, "idx", "title", "level", "offset", "stop", "run_stop", "hollow", "fate")


def strip_contents(chapters: DataFrame, texts: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(texts, chapters) without contents lists, offsets counted anew."""
    fate = contents_runs(chapters, texts, key, text)
    cs = fate.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "title", "level", "offset", "stop", "fate"))).alias("cs"))
    rows = texts.select(key, F.col(text).alias("_t")).join(cs, key, "left")
    sub = lambda t, a, b: F.substring(t, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    t = F.col("_t")
    front = F.when(F.size("cs") > 0, sub(t, F.lit(0).cast("long"), F.col("cs")[0]["offset"])).otherwise(t)

    def piece(c):
        s = sub(t, c["offset"], c["stop"])
        return F.when(c["fate"] == "keep", s).when(c["fate"] == "divider", F.concat(F.regexp_extract(s, "^[^\\n]*", 0), F.when(s.contains("\n"), "\n").otherwise(""))).otherwise("")

    rows = rows.withColumn("pieces", F.concat(F.array(front), F.coalesce(F.transform("cs", piece), F.array().cast("array<string>"))))
    new = rows.select(key, F.array_join("pieces", "").alias(text))
    parts = rows.where("cs is not null").select(key, F.posexplode(F.arrays_zip(F.col("cs"), F.slice("pieces", 2, F.greatest(F.size("cs"), F.lit(1))).alias("p"))).alias("i", "z"), F.length(F.col("pieces")[0]).alias("front"))
    w = Window.partitionBy(key).orderBy("i")
    parts = parts.withColumn("offset", F.col("front") + F.coalesce(F.sum(F.length("z.p")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kept = parts.where("z.cs.fate <> 'drop'")
    return new, kept.select(key, F.row_number().over(w).cast("long").alias("idx"), F.col("z.cs.title").alias("title"), F.col("z.cs.level").alias("level"), "offset")
