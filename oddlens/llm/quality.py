"""Quality rules with host-level verdicts (DataFrame functions only).

Each document is measured against a few rules. The failures of each rule are summed by host; the failure rate of
a host is shrunk with a beta prior that is fitted to all hosts by the method of moments, so that a host with few
documents stays near the average. A host whose shrunk rate passes the limit for any rule is rejected, and its
verdict is joined back to its documents.

Null, empty and blank texts have no words and fail the base rule. Null hosts form one host of their own. Very long texts
are measured whole. Repeated rows are judged one by one and all returned; rates and lengths at a limit pass. measures()
replaces columns of its own names; the stage returns all columns as they were. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlens.llm.common import let, with_few, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rules counted by host, besides the base rule; each is a share of the document.
MAX_SYMBOL_SHARE = 0.10
MAX_DUP_LINE_SHARE = 0.30
WORD_LENGTH = (2.0, 15.0)
#: A host is rejected if the shrunk failure rate of a rule is above this.
MAX_HOST_RATE = 0.5
RULES = ("base", "symbols", "dup_lines", "word_length")


def _repeat_words(w: Column) -> Column:
    """Words in 5-word windows that occur twice or more in w."""

    def covered(hashes: Column) -> Column:
        # Hash and place share a long, so that one sort of longs brings equal windows together; equality is then
        # judged on the whole hash.
        bits = F.ceil(F.log2(F.size(hashes) + F.lit(1.0))).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
        packed = F.transform(hashes, lambda h, i: F.call_function("shiftleft", h, bits).bitwiseOR(i.cast("long")))

        def starts(s: Column) -> Column:
            at = lambda x: F.get(hashes, x.bitwiseAND(mask).cast("int"))
            same = F.transform(s, lambda x, i: F.when((at(x) == at(F.get(s, i - 1))) | (at(x) == at(F.get(s, i + 1))), x.bitwiseAND(mask)))
            return F.sort_array(F.filter(same, lambda p: p.isNotNull()))

        def total(p: Column) -> Column:
            step = F.transform(p, lambda x, i: F.least(F.lit(WINDOW).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW).cast("long"))))
            return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(F.sort_array(packed), starts), total)

    def of(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)]))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return F.when(F.size(w) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(w, of))


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words and base_failed (columns of these names are replaced)."""
    body = F.coalesce(docs[text], F.lit(""))

    def lines(with_word: Column) -> Column:
        return F.struct(F.size(with_word).cast("long").alias("n_lines"), (F.size(with_word) - F.size(F.array_distinct(with_word))).cast("long").alias("n_dup_lines"))

    def measured(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    by_line = let(F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lines)
    m = docs.withColumns({"_m": let(words(docs[text]), measured), "_l": by_line})
    m = m.withColumns({
        "n_words": F.col("_m.n_words"),
        "word_chars": F.col("_m.word_chars"),
        "n_symbols": F.length(F.regexp_replace(body, f"[^{SYMBOLS}]+", "")).cast("long"),
        "n_lines": F.col("_l.n_lines"),
        "n_dup_lines": F.col("_l.n_dup_lines"),
        "n_repeat_words": F.col("_m.n_repeat_words"),
    }).drop("_m", "_l")
    return m.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def _failures() -> dict[str, Column]:
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    per_word = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "base": F.col("base_failed"),
        "symbols": F.col("n_symbols") / chars > MAX_SYMBOL_SHARE,
        "dup_lines": F.col("n_dup_lines") * 10.0 / F.greatest(F.col("n_lines"), F.lit(1)) > 10 * MAX_DUP_LINE_SHARE,
        "word_length": (per_word < WORD_LENGTH[0]) | (per_word > WORD_LENGTH[1]),
    }


def host_verdicts(measured: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """A row for each host: documents, failures and shrunk rate of each rule, and host_ok.

    The prior of a rule has the mean and the variance of the hosts' raw rates; without variance (one host, or equal
    rates) it weighs as much as ten documents.
    """
    counts = measured.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *[F.count_if(x).alias(f"failed_{r}") for r, x in _failures().items()])
    counts = written(counts, "hosts")
    rates = {r: F.col(f"failed_{r}") / F.col("n_docs") for r in RULES}
    prior = counts.agg(*[F.avg(rates[r]).alias(f"m_{r}") for r in RULES], *[F.var_samp(rates[r]).alias(f"v_{r}") for r in RULES])
    weight = {}
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight[r] = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(1.0))).otherwise(F.lit(10.0))
    shrunk = {f"rate_{r}": (F.col(f"failed_{r}") + F.col(f"m_{r}") * weight[r]) / (F.col("n_docs") + weight[r]) for r in RULES}
    out = counts.join(F.broadcast(prior)).withColumns(shrunk)  # one row: means and variances
    bad = F.lit(False)
    for r in RULES:
        bad = bad | (F.col(f"rate_{r}") > max_rate)
    return out.withColumn("host_ok", ~bad).select("host", "n_docs", *[f"failed_{r}" for r in RULES], *shrunk, "host_ok")


def judged(docs: DataFrame, host: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with the measures, base_failed, host_ok and kept."""
    m = measures(docs, text)
    if keep is not None:
        made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
        m = written(m.select(*dict.fromkeys([*keep, host]), *made), "measures")
    verdicts = written(host_verdicts(m, host).select("host", "host_ok"), "verdicts")
    out = with_few(m.drop("host_ok").withColumn("_host", F.col(host)), verdicts.withColumnRenamed("host", "_host"), ["_host"])
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("host_ok"), F.lit(True))).drop("_host")


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judged(docs, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_ok")


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass their own base rule and their host's verdict, with their columns as they are."""
    clash = [c for c in docs.columns if c not in ("doc_id", "text", "source")]
    slim = docs.select("doc_id", "text", "source", F.struct(*[docs[c] for c in clash] or [F.lit(0)]).alias("_more"))
    # texts are measured once: the hosts' counts read the measures of the written table, and its rows that pass are the result
    out = judged(slim, keep=["doc_id", "text", "source", "_more"]).where("kept")
    return out.select(*[F.col(f"_more.`{c}`").alias(c) if c in clash else c for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, w FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM m, unnest(range(1, greatest(n_words - 3, 1))) AS u(i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM rep, unnest(range(0, 5)) AS u(k) GROUP BY doc_id),
f AS (SELECT m.doc_id, source, n_words, word_chars, n_symbols, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM m LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
x AS (SELECT *, n_symbols / greatest(word_chars, 1)::DOUBLE > 0.1 AS f_symbols, n_dup_lines * 10.0::DOUBLE / greatest(n_lines, 1) > 3.0 AS f_dup,
  word_chars::DOUBLE / greatest(n_words, 1) < 2.0 OR word_chars::DOUBLE / greatest(n_words, 1) > 15.0 AS f_len FROM b),
h AS (SELECT source, count(*) AS n, r, count(*) FILTER (WHERE v) AS k FROM (SELECT source, unnest(['base', 'symbols', 'dup_lines', 'word_length']) AS r, unnest([base_failed, f_symbols, f_dup, f_len]) AS v FROM x) GROUP BY source, r),
p AS (SELECT r, avg(k / n::DOUBLE) AS mean, var_samp(k / n::DOUBLE) AS v FROM h GROUP BY r),
q AS (SELECT r, mean, CASE WHEN v > 0 THEN greatest(mean * (1 - mean) / v - 1, 1.0) ELSE 10.0 END AS wt FROM p),
ok AS (SELECT source, bool_and((k + mean * wt) / (n + wt) <= 0.5) AS host_ok FROM h JOIN q USING (r) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_ok AS kept, host_ok
FROM x JOIN ok ON x.source IS NOT DISTINCT FROM ok.source
"""
