"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm import (
    best_fit,
    bpe_tree,
    cross_parse,
    flat_graph,
    ftrl_quality,
    nb_toxicity,
    pareto_mix,
    periodic_runs,
    prefix_trie,
    quality_ledger,
    secret_scan,
    simhash_grid,
    tool_links,
)
from parley.llm.common import table


def op1_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = pareto_mix.mix(table(spark, folder, "documents"))
    return rows.select(F.col("key").alias("doc_id"), "size", "source_size", "target", "taken")


def op2_secret_ownership(spark: SparkSession, folder: str) -> DataFrame:
    rows = secret_scan.judged(table(spark, folder, "documents"))
    base = F.filter("found", lambda f: f["kind"].isin("assign", "access", "hex"))

    def of_kind(kind: str):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def ruled(verdict: str):
        named = F.filter("verdicts", lambda v: v["verdict"] == verdict)
        return F.coalesce(F.size(named), F.lit(0)).cast("long").alias(f"n_{verdict}")

    return rows.select(
        F.col("key").alias("doc_id"),
        of_kind("assign"),
        of_kind("access"),
        of_kind("hex"),
        F.sha2(secret_scan.joined_spans(base), 256).alias("base_sha256"),
        secret_scan.joined_spans(F.col("found")).alias("spans"),
        *[ruled(verdict) for verdict in ("example", "live", "unclear")],
    )


def op3_nb_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return nb_toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


TOOLS = {
    "lookup": {"limit": ("integer", True), "query": ("string", True), "turn": ("integer", False)},
    "search": {"after": ("array", False), "query": ("string", True), "turn": ("integer", True)},
}


def dialogue_calls(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """User turns as calls and assistant turns as their results; identifiers and needs follow the turns.

    The table holds no tools, so tool, needs and faults are told from the numbers of conversation and
    turn: in odd conversations a call needs the next call of the conversation, in even ones the one before.
    Some need two, some need each other, some arguments are broken, some tools unknown, and some calls and
    results repeat the identifier of the one before. The text is the query.
    """
    turns = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("at"), "role", "text"
    )

    def name(turn):
        return F.concat_ws("_", F.lit("call"), F.col("conv").cast("string"), turn.cast("string"))

    conv, at = F.col("conv"), F.col("at")
    odd = conv % 2 == 1
    need = F.when(odd, name(at + 2)).when(at >= 2, name(at - 2))
    other = F.when((conv % 7 == 3) & (at % 64 == 8), name(at - 4)).when((conv % 11 == 6) & (at % 16 == 0), name(at + 2))
    tool = F.when((conv + at) % 17 == 4, "compute").when((conv + at) % 3 == 0, "lookup").otherwise("search")
    shift = F.when((conv * 3 + at) % 38 == 2, F.lit(2)).otherwise(F.lit(0))
    arguments = F.to_json(
        F.struct(
            F.col("at").alias("turn"),
            F.col("text").alias("query"),
            F.when(tool == "search", F.array_compact(F.array(need, other))).alias("after"),
            F.when((tool == "lookup") & (F.col("conv") % 5 != 0), F.col("at") + 1).alias("limit"),
        )
    )
    broken = (conv + at) % 23 == 7
    calls = turns.filter("role = 'user'").select(
        "conv", name(at - shift).alias("id"), "at", tool.alias("tool"),
        F.when(broken, F.substring(arguments, F.lit(2), F.length(arguments))).otherwise(arguments).alias("arguments"),
        F.array_compact(F.array(need, other)).alias("needs"),
    )
    results = turns.filter("role = 'assistant'").select(
        "conv", name(at - 1 - F.when((conv + at) % 29 == 6, F.lit(2)).otherwise(F.lit(0))).alias("id"), "at", F.col("text").alias("content")
    )
    return calls, results


def op4_tool_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = tool_links.linked(*dialogue_calls(spark, folder), TOOLS)
    return rows.select(
        F.col("conv").alias("conv_id"),
        F.col("id").alias("call_id"),
        "place",
        "state",
        F.array_join("problems", ",").alias("problems"),
        "message",
    )


def op5_ftrl_quality(spark: SparkSession, folder: str) -> DataFrame:
    return ftrl_quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_rule_ledger(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality_ledger.ledger(table(spark, folder, "documents"))
    base = ~quality_ledger.passes("v1")
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & quality_ledger.passes()).alias("kept"),
        "failed_bits",
    )


def op7_simhash_grid(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_grid.near_duplicates(table(spark, folder, "documents"))


def op8_bpe_tree(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_tree.encode(table(spark, folder, "documents"), with_ids=False).drop("ids")


def op9_cross_parse(spark: SparkSession, folder: str) -> DataFrame:
    return cross_parse.language(table(spark, folder, "documents"))


def op10_flat_graph(spark: SparkSession, folder: str) -> DataFrame:
    return flat_graph.near_duplicates(table(spark, folder, "embeddings"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    rows = periodic_runs.periodic(docs.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text"))))
    ranked = F.transform(
        "runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))
    )
    best = F.array_max(ranked)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.l") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    rows = best_fit.packed(best_fit.pieces(table(spark, folder, "documents"), with_ids=False).drop("ids"))
    return rows.withColumnRenamed("key", "doc_id")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rows, convs = prefix_trie.spliced(prefix_trie.numbered(table(spark, folder, "conversations")))
    return prefix_trie.trie(rows, convs)


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_nb_toxicity": op3_nb_toxicity,
    "op4_tool_links": op4_tool_links,
    "op5_ftrl_quality": op5_ftrl_quality,
    "op6_rule_ledger": op6_rule_ledger,
    "op7_simhash_grid": op7_simhash_grid,
    "op8_bpe_tree": op8_bpe_tree,
    "op9_cross_parse": op9_cross_parse,
    "op10_flat_graph": op10_flat_graph,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_best_fit": op12_best_fit,
    "op13_prefix_trie": op13_prefix_trie,
}
_BLANK = r"[\x20\x09-\x0D]"
_BITS = " + ".join(
    f"CASE WHEN {rule.fails} THEN {1 << place} ELSE 0 END" for place, rule in enumerate(quality_ledger.RULES)
)
_LEDGER = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
windows AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, CAST(sum(least(8, coalesce(after - i, 8))) AS bigint) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM again) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS bigint) AS n_words, length(regexp_replace(t, '{_BLANK}+', '', 'g')) AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) - list_unique(l) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS n_upper,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutter
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, CAST({_BITS} AS bigint) AS failed_bits FROM m)
SELECT doc_id, n_words, CAST(word_chars AS bigint) AS word_chars, CAST(n_symbols AS bigint) AS n_symbols,
  CAST(n_dup_lines AS bigint) AS n_dup_lines, n_repeat_words, failed_bits & {quality_ledger.mask("v1")} <> 0 AS base_failed,
  failed_bits & {quality_ledger.mask("v1") | quality_ledger.mask(quality_ledger.CURRENT)} = 0 AS kept, failed_bits FROM b"""

#: crc32 of a number's digits, bit by bit
_CRC = """xor(4294967295, list_reduce(flatten(list_transform(string_split(CAST(conv_id AS varchar), ''),
  lambda ch: [CAST(ascii(ch) AS bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
  CAST(4294967295 AS bigint)))"""
_TRIE = f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS l
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
taken AS (SELECT *, {_CRC} % 6 AS h FROM own),
rebuilt AS (SELECT t.conv_id AS c, list_concat(coalesce(b.l, [])[1:t.h], t.l[t.h + 1:]) AS l
  FROM taken t LEFT JOIN own b ON b.conv_id = t.conv_id - t.conv_id % 100),
p AS (SELECT c, d, len(l) = d AS ends, md5(CAST(to_json(l[1:d]) AS varchar)) AS k, l[d].t AS last,
    CASE WHEN d > 0 THEN md5(CAST(to_json(l[1:d - 1]) AS varchar)) END AS up
  FROM (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT d, k, any_value(up) AS up, min(c) AS c, count(*) AS n, coalesce(length(any_value(last)), 0) AS size,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(c AS varchar) END, ',' ORDER BY c), '')) AS ends FROM p GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
joined AS (SELECT nodes.*, coalesce(kids.n, 0) AS kids FROM nodes LEFT JOIN kids USING (d, k)),
below AS (SELECT p.d, p.k, count_if(u.kids = 0) AS leaves, sum((u.n - 1) * u.size) AS saved
  FROM joined u JOIN p ON p.c = u.c AND p.d <= u.d GROUP BY p.d, p.k)
SELECT j.c AS conv_id, j.d AS depth, a.c AS parent_conv_id, j.n AS n_convs, j.kids AS n_children,
  CAST(leaves AS bigint) AS n_leaves, CAST(saved AS bigint) AS saved_tokens, j.ends AS ends_sha256
FROM joined j JOIN below USING (d, k) LEFT JOIN joined a ON a.d = j.d - 1 AND a.k = j.up"""

ORACLES: dict[str, str] = {"op6_rule_ledger": _LEDGER, "op13_prefix_trie": _TRIE}
