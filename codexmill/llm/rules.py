"""Ordered rule lists by incremental reduced-error pruning (IREP), and their export to SQL.

`induce` grows a rule on two thirds of the remaining labelled rows by information gain, prunes its last conditions on
the other third, and keeps adding rules until one is wrong more often than right on the pruning rows.
RULES below is what `quality.fit` gives on documents that are labelled by how they were made (llm/labelled.py); a test
induces it anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

#: Statistics that rules may use, each only in the direction in which it speaks against prose: chance differences the other way round make no rule.
AGAINST = {
    "end_share": "<=", "end_line_share": "<=", "common_share": "<=", "distinct_share": "<=", "letter_ratio": "<=",
    "symbol_ratio": ">", "digit_ratio": ">", "list_share": ">", "table_share": ">", "link_share": ">", "code_share": ">", "keyed_share": ">", "dull_share": ">", "novowel_share": ">",
}
FEATURES = tuple(AGAINST)
#: A rule must be right this often for each time it is wrong, on the pruning rows.
RIGHT = 10
#: A rule must cover so many of the pruning rows; induction ends after so many splits in a row that gave no such rule.
LEAST, TRIES = 5, 8
#: Labelled documents that a fit uses at most.
SAMPLE = 8_000

Rule = list[tuple[str, str, float]]


def covers(rule: Rule, df: pd.DataFrame) -> np.ndarray:
    ok = np.ones(len(df), dtype=bool)
    for f, op, t in rule:
        ok &= (df[f].to_numpy() <= t) if op == "<=" else (df[f].to_numpy() > t)
    return ok


def _grow(pos: pd.DataFrame, neg: pd.DataFrame) -> Rule:
    rule: Rule = []
    while len(neg) and len(pos):
        base = np.log2(len(pos) / (len(pos) + len(neg)))
        best = None
        for f in FEATURES:
            p, n = np.sort(pos[f].to_numpy()), np.sort(neg[f].to_numpy())
            values = np.unique(np.concatenate([p, n]))
            if len(values) < 2:
                continue
            cut = (values[1:] + values[:-1]) / 2
            for op in (AGAINST[f],):
                kp, kn = np.searchsorted(p, cut, "right"), np.searchsorted(n, cut, "right")
                if op == ">":
                    kp, kn = len(p) - kp, len(n) - kn
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(kp > 0, kp * (np.log2(kp / np.maximum(kp + kn, 1)) - base), -1)
                i = int(np.argmax(gain))
                if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                    best = (float(gain[i]), f, op, float(cut[i]))
        if best is None:
            break
        c = best[1:]
        rule.append(c)
        pos, neg = pos[covers([c], pos)], neg[covers([c], neg)]
    return rule


def _tidy(rule: Rule) -> Rule:
    """One condition for each statistic, the tightest; thresholds rounded."""
    out: dict[tuple[str, str], float] = {}
    for f, op, t in rule:
        old = out.get((f, op), t)
        out[f, op] = min(old, t) if op == "<=" else max(old, t)
    return [(f, op, round(t, 4)) for (f, op), t in out.items()]


def _prune(rule: Rule, pos: pd.DataFrame, neg: pd.DataFrame) -> Rule:
    def worth(r: Rule) -> float:
        p, n = covers(r, pos).sum(), covers(r, neg).sum()
        return (p - n) / max(p + n, 1)

    best = max((worth(rule[:k]), -k) for k in range(1, len(rule) + 1))
    return rule[: -best[1]]


def induce(df: pd.DataFrame, label: str = "other", seed: int = 1) -> list[Rule]:
    """Rules for the rows whose `label` is true; df has FEATURES and label."""
    rng = np.random.default_rng(seed)
    df = df.iloc[:SAMPLE]
    pos, neg = df[df[label]], df[~df[label]]
    rules: list[Rule] = []
    failed = 0
    while len(pos) > 3 and failed < TRIES:
        gp, gn = rng.random(len(pos)) < 2 / 3, rng.random(len(neg)) < 2 / 3
        rule = _grow(pos[gp], neg[gn])
        rule = _prune(rule, pos[~gp], neg[~gn]) if rule else rule
        p, n = (covers(rule, pos[~gp]).sum(), covers(rule, neg[~gn]).sum()) if rule else (0, 0)
        if p < LEAST or p <= RIGHT * n:
            failed += 1
            continue
        failed = 0
        rules.append(_tidy(rule))
        pos, neg = pos[~covers(rule, pos)], neg[~covers(rule, neg)]
    return rules


#: The rule list in use, as `quality.fit` gives it for the books of sf0.01: a document is `other` if any rule holds.
RULES: list[Rule] = [
    [("end_share", "<=", 0.0264), ("letter_ratio", "<=", 0.767)],
    [("end_share", "<=", 0.0219), ("common_share", "<=", 0.1455)],
    [("end_share", "<=", 0.0219), ("common_share", "<=", 0.3006), ("distinct_share", "<=", 1.1833), ("keyed_share", ">", 0.5)],
    [("end_share", "<=", 0.0219), ("common_share", "<=", 0.2887), ("distinct_share", "<=", 1.1833), ("list_share", ">", 0.5)],
    [("end_share", "<=", 0.0219), ("common_share", "<=", 0.2886), ("distinct_share", "<=", 1.1714)],
    [("end_share", "<=", 0.0543), ("distinct_share", "<=", 0.9833)],
    [("end_share", "<=", 0.0219), ("keyed_share", ">", 0.5)],
    [("end_share", "<=", 0.0219), ("list_share", ">", 0.5)],
    [("end_share", "<=", 0.0264), ("distinct_share", "<=", 1.1339)],
    [("letter_ratio", "<=", 0.7881), ("list_share", ">", 0.2436)],
    [("distinct_share", "<=", 0.6056)],
    [("end_share", "<=", 0.968), ("keyed_share", ">", 0.0372), ("letter_ratio", "<=", 0.8007)],
]


def case_expression(rules: list[Rule] | None = None) -> str:
    """The rule list as an SQL CASE expression over the statistics."""
    rules = RULES if rules is None else rules
    whens = " ".join("when " + " and ".join(f"{f} {op} {t!r}" for f, op, t in r) + " then 'other'" for r in rules)
    return f"case when chars = 0 then null {whens} else 'prose' end"
