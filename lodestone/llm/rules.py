"""Quality rules with risk-controlled thresholds; DataFrame functions only.

Base counts per document; a document fails the base rules with fewer than 50 words, or with over half of its words in
3-word windows that occur twice or more. Beyond these, each rule scores documents (higher is worse). The rules' cutoffs
form one ladder: rung k holds the k-th cutoff of every rule, from lenient to strict, and rejects a document that is above
any of them. A labelled holdout (quality 1 and not failed by the base rules) chooses the rung, for each stratum (lang) and
for all strata together:
- rungs are fixed before any data are seen, and tried from the most lenient on (fixed-sequence testing);
- a rung is accepted while the exact binomial test rejects "it falsely rejects more than `risk` of good documents":
  P(Bin(n, risk) <= hits) <= alpha / (strata + 1), a Bonferroni correction over the strata and the pooled one.
So with probability 1 - alpha, in all strata at once, at most `risk` of a stratum's good documents are rejected beyond the
base rules. A stratum with too few labels for a rung of its own takes the pooled one, whose bound then holds for good
documents of all strata together; without that it rejects nothing beyond the base rules.

Windows are compared by 64-bit hashes within one document. Defined results: null text has no words and fails; null lang
is a stratum of its own; labels that are null, or that name no document, are not used; a doc_id labelled twice counts
twice; repeated rows are judged alike; empty tables give no cutoffs and no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled, stored

RISK = 0.025
ALPHA = 0.05
#: Most strata whose rungs are broadcast.
MOST_STRATA = 50_000
#: The name of all strata together; a language's stratum begins with "=".
EVERY = "every"
MIN_WORDS = 50
MOST_REPEATED = 50  # percent of words
#: Score of each rule, and its cutoffs from lenient to strict: one for each rung.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "repeated_words": ("100D * n_repeat_words / greatest(n_words, 1)", (45, 40, 35, 30, 27, 24, 22, 20, 18, 15)),
    "symbols": ("100D * n_symbols / greatest(word_chars, 1)", (40, 30, 20, 15, 10, 8, 6, 4, 3, 2)),
    "duplicate_lines": ("100D * n_dup_lines / greatest(n_lines, 1)", (90, 80, 70, 60, 50, 45, 40, 35, 30, 25)),
    "long_words": ("CAST(word_chars AS DOUBLE) / greatest(n_words, 1)", (40, 30, 25, 20, 16, 14, 12, 10, 9, 8)),
    "shouting": ("100D * n_shouts / greatest(n_words, 1)", (90, 75, 60, 45, 30, 20, 15, 10, 7, 5)),
}
RUNGS = 10
_SPACE = r"[\x20\x09-\x0D]"


def _let(value: Column, f) -> Column:
    """f(value), with value computed once for each row."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _repeated(w: Column, n: Column) -> Column:
    """Words in 3-word windows found twice or more: sort the windows' hashes, keep neighbours that agree, join their spans."""
    windows = F.transform(F.slice(w, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    def spans(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda p, k: F.when(k > 0, F.get(s, k - 1)["h"] == p["h"]).otherwise(False) | F.coalesce(F.get(s, k + 1)["h"] == p["h"], F.lit(False)))
        starts = F.sort_array(F.transform(_let(pairs, twice), lambda p: p["i"]))
        none = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        total = F.aggregate(starts, none, lambda a, i: F.struct((i + 3).alias("end"), (a["n"] + i + 3 - F.greatest(i, a["end"])).alias("n")))
        return total["n"]

    return _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(spans(h)))


def counted(docs: DataFrame) -> DataFrame:
    """`_row` (a row of docs) and the base counts of its text."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, _SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), _repeated(w, F.size(w)).alias("n_repeat_words"), F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)).alias("word_chars")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), of_words.alias("w"), of_lines.alias("l"), text.alias("t"))
    symbols = F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))
    shouts = F.length("t") - F.length(F.translate("t", "!", ""))
    columns = {"n_words": F.col("w.n_words"), "word_chars": F.col("w.word_chars"), "n_symbols": symbols, "n_dup_lines": F.col("l.n_dup_lines"), "n_repeat_words": F.col("w.n_repeat_words"), "n_lines": F.col("l.n_lines"), "n_shouts": shouts}
    # Out of a one-element array: a later filter on counts stays above it, so each count is worked out once.
    counts = F.array(F.struct(*[c.cast("long").alias(k) for k, c in columns.items()]))
    return rows.select("_row", F.inline(counts))


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words")


def _tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), term by term in logarithms; 1 where k >= n p, which no test would accept."""
    ln = lambda x: F.ln(x.cast("double"))
    none = n * F.log1p(F.lit(-p))
    first = F.struct(none.alias("term"), F.exp(none).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] + ln(n - i + 1) - ln(i) + F.log(F.lit(p)) - F.log1p(F.lit(-p))
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.aggregate(steps, first, step)["sum"])


def rung() -> Column:
    """The first rung that rejects a row by its counts; RUNGS if none does."""
    return F.least(*[sum((F.expr(f"int(({score}) <= {c})") for c in grid), F.lit(0)) for score, grid in RULES.values()])


def cutoffs(good: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """(stratum, rung: the strictest accepted) from counts of good labelled documents with their `stratum`; strata without
    one are left out."""
    rows = good.where(~base_failed()).select("stratum", rung().alias("_rung"))
    rows = rows.select(F.explode(F.array("stratum", F.lit(EVERY))).alias("stratum"), "_rung")
    hits = F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("_rung") <= k).alias("hits")) for k in range(RUNGS)])
    counts = rows.groupBy("stratum").agg(F.count("*").alias("n"), hits.alias("tried"))
    counts = counts.withColumn("strata", F.expr("count(*) over (partition by 0)"))  # one row for each stratum
    tests = counts.select("stratum", "strata", "n", F.inline("tried"))
    tests = tests.withColumn("ok", (_tail(F.col("n"), F.col("hits"), risk) <= F.lit(alpha) / F.col("strata")).cast("int"))
    tests = tests.withColumn("so_far", F.expr("min(ok) over (partition by stratum order by k)"))
    return tests.where("so_far = 1").groupBy("stratum").agg(F.max("k").alias("rung"))


def stratum(lang: str = "_row.lang") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("null"))


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Counted rows with base_failed and kept."""
    pooled = found.where(F.col("stratum") == EVERY).first()
    own = found.where(F.col("stratum") != EVERY).withColumnRenamed("rung", "_accepted")
    # A row for each stratum: sent to all tasks as long as strata are few, else Spark's own choice of join.
    own = F.broadcast(own) if own.limit(MOST_STRATA + 1).count() <= MOST_STRATA else own
    rows = rows.withColumn("stratum", stratum()).join(own, "stratum", "left")
    accepted = F.coalesce("_accepted", F.lit(pooled["rung"] if pooled else -1))
    rows = rows.withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (rung() > accepted)).drop("stratum", "_accepted")


def good_labels(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_doc"))


def verdicts(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of docs; counted once, kept in the shared folder."""
    rows = settled(counted(docs.select("doc_id", "lang", "text")).withColumn("_row", F.struct("_row.doc_id", "_row.lang")))
    good = rows.join(good_labels(labels), F.col("_row.doc_id") == F.col("_doc")).withColumn("stratum", stratum())
    return judged(rows, settled(cutoffs(good, risk, alpha))).select("_row.doc_id", "*").drop("_row", "n_lines", "n_shouts")


def kept(docs: DataFrame, labels: DataFrame, risk: float = RISK, alpha: float = ALPHA) -> DataFrame:
    """The rows of docs that stay. Rows and their counts are written once, to the shared folder; labels meet the counts'
    columns alone, so no text is moved by key, at any size, or counted twice."""
    rows = stored(counted(docs))
    good = rows.withColumn("_row", F.struct("_row.doc_id", "_row.lang")).join(good_labels(labels), F.col("_row.doc_id") == F.col("_doc"))
    return judged(rows, settled(cutoffs(good.withColumn("stratum", stratum()), risk, alpha))).where("kept").select("_row.*")


def oracle(risk: float = RISK, alpha: float = ALPHA) -> str:
    """DuckDB SQL for the query's rows: windows by words themselves, binomial tails by log-gamma."""
    scores = [(score.replace("100D", "100.0").replace("CAST(word_chars AS DOUBLE)", "1.0 * word_chars"), grid) for score, grid in RULES.values()]
    rungs = ", ".join("(" + " + ".join(f"CAST(CAST({score} AS DOUBLE) <= {c} AS INT)" for c in grid) + ")" for score, grid in scores)
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
x AS (SELECT doc_id, lang, text, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM x)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
v AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS q FROM r WHERE c > 1) GROUP BY doc_id),
c AS (SELECT x.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, length(text) - length(translate(text, '!', '')) AS n_shouts
  FROM x LEFT JOIN v ON v.doc_id = x.doc_id),
m AS (SELECT *, coalesce('=' || lang, 'null') AS stratum, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, least({rungs}) AS rung FROM c),
s AS (SELECT unnest([stratum, '{EVERY}']) AS stratum, rung FROM m JOIN labels USING (doc_id) WHERE quality = 1 AND NOT base_failed),
h AS (SELECT stratum, k, count(*) AS n, count(*) FILTER (rung <= k) AS hits FROM s, range({RUNGS}) q(k) GROUP BY ALL),
b AS (SELECT *, CASE WHEN hits >= n * {risk} THEN 1 ELSE list_sum(list_transform(range(0, hits + 1), lambda i: exp(lgamma(n + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(n - i + 1) + i * ln({risk}) + (n - i) * ln(1 - {risk})))) END
  <= {alpha} / (SELECT count(DISTINCT stratum) FROM h) AS ok FROM h),
f AS (SELECT stratum, max(k) AS accepted FROM (SELECT *, min(ok::INT) OVER (PARTITION BY stratum ORDER BY k) AS so_far FROM b) WHERE so_far = 1 GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rung > coalesce(f.accepted, (SELECT accepted FROM f WHERE stratum = '{EVERY}'), -1) AS kept FROM m LEFT JOIN f ON f.stratum = m.stratum"""
