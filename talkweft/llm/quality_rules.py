"""Quality rules whose cutoffs carry a bound on false rejection.

Each rule rejects a document whose measure is at or over a cutoff of a fixed grid. In every stratum (language)
the labelled documents are the holdout. One walk goes over sets of cutoffs, from the most lenient on: each step
lowers one rule's cutoff to the next cell that holds a bad document; steps at high cells that many bad documents
reach come first, see walks(). The order comes from the bad documents alone, so the good ones test it untouched. A step is certified while the exact (Clopper-Pearson)
upper bound on the share of good documents that all its rules reject together stays within ALPHA; the walk stops
at its first failure (fixed-sequence testing, so the steps need no further correction). DELTA is divided among the
strata that are tested and the pool (Bonferroni). A stratum with fewer good labelled documents than could certify
a step that rejects none of them (least_good()) isn't tested: it takes the cutoffs of the pool, the labelled
documents of all strata, which are tested like a stratum's; so do languages without labels. With confidence
1 - DELTA the rules reject at most a share ALPHA of the good documents of every tested stratum, and the pool's at
most that share of the good documents of all strata together, which says less of one small stratum by itself. Of
the certified steps that with the best gain, bad share rejected less PENALTY times the good share, is used; none,
if no gain is over 0.

Edge cases: null or empty texts have no words, so they fail the base; a null language is a stratum of its own;
languages beyond the STRATA most labelled ones share one stratum; labels are taken once per document (the largest);
null labels are ignored; without labels, or with too few good ones in all, nothing is certified and only the base decides. Rows repeat as they came; very long texts
are measured whole; an empty table gives no rows; other columns are not read, so names can't clash. The bound speaks of good
documents that pass the base: what the base rejects is not the method's.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, filter_batches, map_batches, written

ALPHA, DELTA, PENALTY, STRATA = 0.02, 0.05, 10.0, 64
GRID = 64
WS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91))
POOL, OTHER, NONE = "\0pool", "\0other", "\0none"  # strata that are no languages
MEASURES = ("symbols_a_word", "upper_share", "marks_a_word", "repeat_share", "dup_line_share")
FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, bins array<int>"


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often, upto, total = {w for w, n in Counter(windows).items() if n > 1}, 0, 0
    for i, w in enumerate(windows):
        if w in often:
            total += i + width - max(i, upto)
            upto = i + width
    return total


def measures(text: str | None) -> tuple:
    """The base counts, whether the base fails, and the grid cell of every measure."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(data.translate(None, WS)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    again = repeated(words)
    failed = n < 50 or 100 * again > 50 * n
    some = max(n, 1)
    marks = data.count(b"!") + data.count(b"?") + data.count(b"|")
    upper = len(data) - len(data.translate(None, LETTERS))
    shares = (n_symbols / some, upper / max(word_chars, 1), marks / some, again / some, dup / max(len(lines), 1))
    return n, word_chars, n_symbols, dup, again, failed, [min(GRID - 1, int(s * GRID)) for s in shares]


def rule_features(docs: DataFrame) -> DataFrame:
    def make():
        def work(x: dict) -> dict:
            rows = [measures(t) for t in x["text"]]
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "bins")
            return {"doc_id": x["doc_id"], "lang": x["lang"]} | {k: [r[i] for r in rows] for i, k in enumerate(names)}

        return work

    return map_batches(docs.select("doc_id", "lang", "text"), make, FEATURES)


def upper_bound(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the largest p for which at most k of n still has probability ``delta``."""
    if k >= n:
        return 1.0

    def below(p: float) -> float:
        at = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
        term = total = 1.0  # terms fall away from k downwards while k is under the mean
        for i in range(k, 0, -1):
            term *= i / (n - i + 1) * (1 - p) / p
            total += term
            if term < 1e-17 * total:
                break
        return math.exp(min(0.0, at + math.log(total)))

    low, high = max(k / n, 1e-12), 1 - 1e-12
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > delta else (low, mid)
    return high


def least_good(delta: float) -> int:
    """The fewest good documents with which a step that rejects none of them is certified."""
    return math.ceil(math.log(delta) / math.log1p(-ALPHA))


def labelled_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum, quality and bins of the labelled documents that pass the base."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = features.where("NOT base_failed").join(marks, "doc_id").select(F.coalesce("lang", F.lit(NONE)).alias("stratum"), "quality", "bins")
    known = written(known, "labelled")
    top = known.groupBy("stratum").count().orderBy(F.desc("count"), "stratum").limit(STRATA).select("stratum", F.lit(True).alias("own"))
    return known.join(F.broadcast(top), "stratum", "left").select(F.when(F.col("own"), F.col("stratum")).otherwise(F.lit(OTHER)).alias("stratum"), "quality", "bins")


def labelled_counts(known: DataFrame) -> list:
    """Labelled documents by stratum, rule and grid cell: at most (STRATA + 1) x rules x GRID rows of each quality."""
    return known.select("stratum", "quality", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "quality", "rule", "bin").agg(F.count(F.lit(1)).alias("n")).collect()


def walks(counts: list) -> dict[str, list[tuple[int, int]]]:
    """For each stratum and the pool the steps (rule, cell): cells with bad documents, those of rules that tell most first.

    A step counts its cell times the share of bad documents at or over it; no cell comes after a lower one of its rule.
    """
    bad: dict[str, Counter] = {s: Counter() for s in [*{r["stratum"] for r in counts}, POOL]}
    for r in counts:
        if r["quality"] != 1:
            for s in (r["stratum"], POOL):
                bad[s][r["rule"], r["bin"]] += r["n"]
    out = {}
    for s, n in bad.items():
        steps = []
        for rule in range(len(MEASURES)):
            worth, over = 0, sum(v for (i, _), v in n.items() if i == rule)
            for cell in sorted(c for i, c in n if i == rule):
                worth = max(worth, cell * over)
                over -= n[rule, cell]
                if cell > 0:
                    steps.append((-worth, -cell, rule))
        out[s] = [(rule, -cell) for _, cell, rule in sorted(steps)]
    return out


def first_steps(walk: list[tuple[int, int]]) -> list[list[int]]:
    """For each rule and cell the first step at which the rule rejects it; the walk's length if none does."""
    first = [[len(walk)] * GRID for _ in MEASURES]
    for k, (rule, cell) in enumerate(walk):
        first[rule][cell:] = [min(k, x) for x in first[rule][cell:]]
    return first


def step_counts(known: DataFrame, counts: list) -> Counter:
    """Documents by stratum (and pool), quality and the first step at which any rule rejects them."""
    made = {s: first_steps(w) for s, w in walks(counts).items()}
    steps = known.sparkSession.createDataFrame([(s, x, made[POOL]) for s, x in made.items()], "stratum string, own array<array<int>>, pool array<array<int>>")
    step = lambda name: F.array_min(F.array(*[F.col(name)[i][F.col("bins")[i]] for i in range(len(MEASURES))]))
    both = F.explode(F.array(F.struct(F.col("stratum").alias("s"), step("own").alias("k")), F.struct(F.lit(POOL).alias("s"), step("pool").alias("k"))))
    rows = known.join(F.broadcast(steps), "stratum").select("quality", both.alias("x")).groupBy("x.s", "quality", "x.k").agg(F.count(F.lit(1)).alias("n")).collect()
    return Counter({(r["s"], r["quality"] == 1, r["k"]): r["n"] for r in rows})


def _added_up(counts: list) -> Counter:
    """step_counts() from single rules: a document that several rules reject counts for each, so losses are bounded from above."""
    made, out = {s: first_steps(w) for s, w in walks(counts).items()}, Counter()
    for r in counts:
        for s in (r["stratum"], POOL):
            out[s, r["quality"] == 1, made[s][r["rule"]][r["bin"]]] += r["n"]
    return out


def choose_cutoffs(counts: list, reached: Counter | None = None) -> dict[str, list[int]]:
    """For each stratum, and OTHER, the cell from which each rule rejects; GRID where the rule isn't used."""
    reached = _added_up(counts) if reached is None else reached
    sums = Counter()
    for r in counts:
        sums[r["stratum"], r["quality"] == 1, r["rule"]] += r["n"]
    strata = sorted({r["stratum"] for r in counts})
    total = {(s, good): max(sums[s, good, i] for i in range(len(MEASURES))) for s in strata for good in (True, False)}
    total |= {(POOL, good): sum(total[s, good] for s in strata) for good in (True, False)}
    largest = sorted(strata, key=lambda s: (-total[s, True], s))
    tested = max((k for k in range(1, len(largest) + 1) if total[largest[k - 1], True] >= least_good(DELTA / (k + 1))), default=0)
    own, delta = set(largest[:tested]), DELTA / (tested + 1)  # chosen by counts alone, which say nothing of the measures

    def certified(s: str, walk: list[tuple[int, int]]) -> list[int]:
        n_good, n_bad = total[s, True], total[s, False]
        cuts, found, best, lost, won = [GRID] * len(MEASURES), [GRID] * len(MEASURES), 0.0, 0, 0
        for k, (rule, cell) in enumerate(walk):
            cuts[rule] = cell
            lost, won = lost + reached[s, True, k], won + reached[s, False, k]
            if not n_good or upper_bound(lost, n_good, delta) > ALPHA:
                break
            gain = won / max(n_bad, 1) - PENALTY * lost / n_good
            if gain > best + 1e-12:
                best, found = gain, cuts.copy()
        return found

    made = walks(counts)
    pool = certified(POOL, made[POOL])
    return {OTHER: pool} | {s: certified(s, made[s]) if s in own else pool for s in strata}


def cutoffs_of(features: DataFrame, labels: DataFrame) -> dict[str, list[int]]:
    known = labelled_rows(features, labels)
    counts = labelled_counts(known)
    return choose_cutoffs(counts, step_counts(known, counts))


def verdict(cutoffs: dict[str, list[int]]) -> F.Column:
    """True for rows of rule_features() that neither the base nor a certified rule rejects."""
    rejected = F.lit(False)
    stratum = F.coalesce("lang", F.lit(NONE))
    named = [s for s in cutoffs if s != OTHER]
    for s, cuts in cutoffs.items():
        here = ~stratum.isin(named) if s == OTHER else stratum == s
        for rule, cut in enumerate(cuts):
            if cut < GRID:
                rejected = rejected | (here & (F.col("bins")[rule] >= cut))
    return ~(F.col("base_failed") | rejected)


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the base columns and ``kept`` for every row of ``docs``."""
    features = written(rule_features(docs), "rule-features")
    cutoffs = cutoffs_of(features, labels)
    return features.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", verdict(cutoffs).alias("kept"))


def keep_by_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of documents.

    Cutoffs come from the labelled documents alone; the verdict is then made beside each text, so that no
    text is shuffled.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    ids = labels.where("quality IS NOT NULL").select("doc_id").distinct()
    features = written(rule_features(by_ids(docs.select(*cols), ids, "left_semi")), "rule-features")
    cutoffs = cutoffs_of(features, labels)

    def make():
        named = {s for s in cutoffs if s != OTHER}
        none = [GRID] * len(MEASURES)

        def work(texts: list, langs: list) -> list[bool]:
            keep = []
            for text, lang in zip(texts, langs, strict=True):
                *_, failed, bins = measures(text)
                s = NONE if lang is None else lang
                cuts = cutoffs.get(s if s in named else OTHER, none)
                keep.append(not failed and all(b < c for b, c in zip(bins, cuts, strict=True)))
            return keep

        return work

    return filter_batches(docs.select(*cols), make, ["text", "lang"])
