"""The engine's queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .crafted import CRAFTED
from .functions import columns as C
from .operators import diff, nodes, tokenize, vocabulary
from .plans import jobs
from .schema import VOID_TAGS

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_A = C.APOSTROPHES.replace("'", "''")
_PIECES = f"([{C.W_CLASS}{_A}+/=]+|[^{C.W_CLASS}{_A}+/=]+)"
_WORDS = f"((?:[{C.W_CLASS}]+[{_A}]?)+)"


def query(name: str, sql: str | None = None) -> Callable[[Callable], Callable]:
    """Registers a function of a table reader."""

    def add(fn: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def _joined(pieces):
    return F.md5(F.array_join(pieces, "|"))


@query("first_split", f"SELECT doc_id, len(p)::INTEGER AS n_pieces, md5(array_to_string(p, '|')) AS pieces_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{_PIECES}') AS p FROM documents)")
def first_split(table):
    return table("documents").select("doc_id", C.first_pieces(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n_pieces"), _joined("p").alias("pieces_md5"))


@query("word_split", f"SELECT doc_id, len(p)::INTEGER AS n_words, md5(array_to_string(p, '|')) AS words_md5 FROM (SELECT doc_id, regexp_extract_all(text, '{_WORDS}') AS p FROM documents)")
def word_split(table):
    return table("documents").select("doc_id", C.words(F.col("text")).alias("p")).select("doc_id", F.size("p").alias("n_words"), _joined("p").alias("words_md5"))


def _share(chars: str) -> str:
    return f"length(regexp_replace(t, '[^{chars}]', '', 'g'))::DOUBLE / length(t)"


_SKEW = f"greatest(abs({_share('A-Z')} - 26::DOUBLE / 62), abs({_share('a-z')} - 26::DOUBLE / 62), abs({_share('0-9')} - 10::DOUBLE / 62))"


@query(
    "base64_likeness",
    f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS t FROM documents UNION SELECT replace(replace(to_base64(unhex(md5(doc_id::VARCHAR))), '+', ''), '/', '') FROM documents), "
    f"s AS (SELECT t, CASE WHEN regexp_matches(t, '^[A-Za-z0-9]+$') THEN {_SKEW} END AS s FROM t) "
    "SELECT t AS token, round(s, 9) AS skew, length(t) > 4 AND coalesce(s <> 0 AND 1 - s >= 0.92, false) AS base64_like FROM s",
)
def base64_likeness(table):
    docs = table("documents")
    made = F.regexp_replace(F.base64(F.unhex(F.md5(F.col("doc_id").cast("string")))), "[+/]", "")
    tokens = docs.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"))).alias("token")).union(docs.select(made)).distinct()
    return tokens.select("token", F.round(C.skew(F.col("token")), 9).alias("skew"), C.is_base64_like(F.col("token")).alias("base64_like"))


_HEX = "regexp_matches(t, '^(?i)(?:0x|[0-9a-f]{2})[0-9a-f]{6,}$')"


@query(
    "long_tokens",
    f"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[{C.W_CLASS}]+')) AS t FROM documents), "
    f"c AS (SELECT doc_id, t, CASE WHEN {_HEX} AND regexp_matches(t, '^[0-9]+$') AND length(t) <= 4300 THEN 'digits' WHEN {_HEX} THEN 'hex digits' "
    "WHEN length(t) > 32 THEN CASE WHEN regexp_matches(t, '\\p{Nd}') THEN 'alphanumeric' ELSE 'alphabetic' END END AS k FROM t) "
    "SELECT doc_id, t AS token, k AS long_class FROM c WHERE k IS NOT NULL",
)
def long_tokens(table):
    tokens = table("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"([{C.W_CLASS}]+)"))).alias("token"))
    return tokens.withColumn("long_class", C.long_class(F.col("token"))).where("long_class is not null")


@query("underscore_split", "SELECT page_id, array_to_string(string_split(url, '_'), '|') AS parts, len(string_split(url, '_'))::INTEGER AS n_parts FROM pages")
def underscore_split(table):
    parts = F.split("url", "_", -1)
    return table("pages").select("page_id", F.array_join(parts, "|").alias("parts"), F.size(parts).alias("n_parts"))


@query(
    "prefixed_hex",
    "WITH t AS (SELECT doc_id, '0x' || lower(to_hex(doc_id)) || CASE WHEN lang = 'en' THEN '==' ELSE '' END AS t FROM documents) "
    "SELECT doc_id, array_to_string(list_filter([regexp_extract(t, '^(0x)([0-9a-f]+)([+/=]*)$', 1), regexp_extract(t, '^(0x)([0-9a-f]+)([+/=]*)$', 2), regexp_extract(t, '^(0x)([0-9a-f]+)([+/=]*)$', 3)], lambda x: x <> ''), ' ') AS parts FROM t",
)
def prefixed_hex(table):
    text = F.concat(F.lit("0x"), F.lower(F.hex("doc_id")), F.when(F.col("lang") == "en", "==").otherwise(""))
    return table("documents").select("doc_id", F.array_join(C.prefixed_hex(text), " ").alias("parts"))


@query("entity_boundaries", "SELECT page_id, md5(regexp_replace(replace(html, '&apos;', ''''), '&[A-Za-z0-9]+;', ' ', 'g')) AS cut_md5 FROM pages")
def entity_boundaries(table):
    return table("pages").select("page_id", F.md5(C.entities_cut(F.col("html"))).alias("cut_md5"))


@query(
    "void_tags",
    f"SELECT tag, count(*) AS n, lower(tag) IN ({', '.join(repr(t) for t in VOID_TAGS)}) AS is_void FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) AS tag FROM pages) GROUP BY tag",
)
def void_tags(table):
    tags = table("pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("is_void", C.is_void(F.col("tag")))


@query(
    "phi_statistic",
    f"WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[{C.W_CLASS}]+')) AS t FROM documents), "
    "c AS (SELECT t, c, count(*) AS f FROM (SELECT t, unnest(string_split(t, '')) AS c FROM t) GROUP BY t, c) "
    "SELECT t AS token, sum(f * (f - 1))::BIGINT AS phi FROM c GROUP BY t",
)
def phi_statistic(table):
    tokens = table("documents").select(F.explode(F.regexp_extract_all("text", F.lit(f"([{C.W_CLASS}]+)"))).alias("token")).distinct()
    return tokens.withColumn("phi", C.phi(F.col("token")))


@query("probable_words", f"SELECT DISTINCT t AS token, length(t) % 4 <> 0 AND length(t) < 32 AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}]+$') AS probably_word FROM (SELECT unnest(regexp_extract_all(url, '[{C.W_CLASS}]+')) AS t FROM pages)")
def probable_words(table):
    tokens = table("pages").select(F.explode(F.regexp_extract_all("url", F.lit(f"([{C.W_CLASS}]+)"))).alias("token")).distinct()
    return tokens.withColumn("probably_word", C.probably_word(F.col("token")))


@query("cache_keys", "SELECT n_name, r_name, sha256(r_name || chr(0) || coalesce(n_name, '')) || '.jsonl' AS cache_key FROM nation JOIN region ON n_regionkey = r_regionkey")
def cache_keys(table):
    both = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select("n_name", "r_name", C.cache_key(F.col("r_name"), F.col("n_name")).alias("cache_key"))


@query(
    "rounded_sizes",
    "WITH v AS (SELECT p_partkey, (p_partkey + 1) * (p_partkey + 1) * 37 AS v FROM part), u AS (SELECT p_partkey, v, floor(floor(log10(v)) / 3)::INTEGER AS u FROM v) "
    "SELECT p_partkey, round_even(v / pow(1000.0, u), 0)::BIGINT || ['', 'k', 'M', 'B', 'T', 'Q'][u + 1] AS rounded FROM u",
)
def rounded_sizes(table):
    return table("part").select("p_partkey", C.round_and_prefix((F.col("p_partkey") + 1) * (F.col("p_partkey") + 1) * 37).alias("rounded"))


@query("frequent_tokens", f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORDS}')) AS token FROM documents) GROUP BY token ORDER BY n DESC, token LIMIT {vocabulary.DEFAULT_SIZE}")
def frequent_tokens(table):
    words = table("documents").select(C.words(F.col("text")).alias("tokens"))
    return vocabulary.most_frequent(vocabulary.token_counts(words), vocabulary.DEFAULT_SIZE)


@query("dump_order", "SELECT doc_id, row_number() OVER (ORDER BY length(text), doc_id) AS place FROM documents")
def dump_order(table):
    return jobs.dump_order(table("documents"), "text", "doc_id").select("doc_id", "place")


def _snapshots(table) -> DataFrame:
    return tokenize.snapshots_of_pages(table("pages"))


@query("breaking_inputs", "SELECT page_id, url FROM pages WHERE NOT contains(html, '</body>')")
def breaking_inputs(table):
    """Snapshots of pages without an end of the body lose theirs, so that they break."""
    rows = _snapshots(table).withColumn("dom_snapshot", F.when(F.col("html").contains("</body>"), F.col("dom_snapshot")).otherwise(F.expr("left(dom_snapshot, length(dom_snapshot) - 1)")))
    return jobs.breaking(rows).select("page_id", "url")


@query("profile_rows", f"SELECT doc_id, length(text) AS characters, len(w)::BIGINT AS pre_tokens, CASE WHEN len(w) > 0 THEN length(text) / len(w) END AS characters_per_token FROM (SELECT doc_id, text, regexp_extract_all(text, '{_WORDS}') AS w FROM documents)")
def profile_rows(table):
    words = table("documents").select("doc_id", "text", C.words(F.col("text")).alias("tokens"))
    return jobs.profile(words, text="text").drop("text", "tokens")


@query("profile_total", f"SELECT count(*) AS examples, sum(length(text))::BIGINT AS characters, sum(len(w))::BIGINT AS pre_tokens, sum(length(text)) / sum(len(w)) AS characters_per_token FROM (SELECT text, regexp_extract_all(text, '{_WORDS}') AS w FROM documents)")
def profile_total(table):
    words = table("documents").select("text", C.words(F.col("text")).alias("tokens"))
    return jobs.profile_total(jobs.profile(words, text="text"))


@query("string_decode", "SELECT n_nationkey, r_name AS decoded FROM nation LEFT JOIN region ON r_regionkey = n_regionkey - 1")
def string_decode(table):
    strings = table("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]).alias("strings"))
    return table("nation").crossJoin(F.broadcast(strings)).select("n_nationkey", nodes.decoded(F.col("strings"), F.col("n_regionkey") - 1).alias("decoded"))


@query(
    "subtree_ends",
    "WITH t AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i FROM part), "
    "p AS (SELECT p_brand, i, CASE WHEN i = 0 THEN -1 ELSE i & (i - 1) END AS parent, count(*) OVER (PARTITION BY p_brand) AS n FROM t) "
    "SELECT a.p_brand, a.i::INTEGER AS node_index, coalesce(min(b.i), any_value(a.n))::INTEGER AS subtree_end FROM p a LEFT JOIN p b ON a.p_brand = b.p_brand AND b.i > a.i AND b.parent < a.i GROUP BY a.p_brand, a.i",
)
def subtree_ends(table):
    """Each brand's parts as a tree in which a node's parent lacks the node's lowest bit."""
    numbered = table("part").select("p_brand", (F.row_number().over(W.partitionBy("p_brand").orderBy("p_partkey")) - 1).alias("i"))
    parent = F.when(F.col("i") == 0, -1).otherwise(F.col("i").bitwiseAND(F.col("i") - 1))
    trees = numbered.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", parent.alias("parent")))), lambda r: r["parent"]).alias("parents"))
    return nodes.subtree_ends(trees).select("p_brand", F.posexplode("ends").alias("node_index", "subtree_end"))


@query("attribute_pairs", "SELECT c_custkey, (2 * i)::INTEGER AS name, (2 * i + 1)::INTEGER AS value FROM (SELECT c_custkey, unnest(range(0, (c_nationkey + 1) // 2)) AS i FROM customer)")
def attribute_pairs(table):
    flat = F.when(F.col("c_nationkey") > 0, F.sequence(F.lit(0), F.col("c_nationkey") - 1 + F.col("c_nationkey") % 2)).otherwise(F.array().cast("array<int>"))
    return table("customer").select("c_custkey", F.explode(nodes.attribute_pairs(flat)).alias("pair")).select("c_custkey", "pair.name", "pair.value")


@query("unwrapped_snapshots", "SELECT page_id, url AS document_url, 1 AS n_documents FROM pages")
def unwrapped_snapshots(table):
    """Snapshots of long pages come as browsers' responses, the others bare."""
    rows = _snapshots(table)
    wrapped = F.concat(F.lit('{"id":1,"result":'), "dom_snapshot", F.lit("}"))
    rows = rows.withColumn("dom_snapshot", F.when(F.length("html") > 2000, wrapped).otherwise(F.col("dom_snapshot")))
    document = F.element_at("documents", 1)
    return nodes.parsed(rows).select("page_id", nodes.decoded(F.col("strings"), document["documentURL"]).alias("document_url"), F.size("documents").alias("n_documents"))


@query("string_memo", "SELECT count(*) AS strings, count(DISTINCT s) AS distinct_strings FROM (SELECT unnest(string_split(text, chr(10))) AS s FROM documents)")
def string_memo(table):
    lines = table("documents").select(F.explode(F.split("text", "\n", -1)).alias("s"))
    return lines.groupBy("s").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("strings"), F.count(F.lit(1)).alias("distinct_strings"))


@query("changed_rows", f"SELECT doc_id FROM documents WHERE regexp_extract_all(text, '{_WORDS}') IS DISTINCT FROM regexp_extract_all(replace(text, 'qu', 'kw'), '{_WORDS}')")
def changed_rows(table):
    rows = table("documents").select("doc_id", C.words(F.col("text")).alias("a"), C.words(F.replace("text", F.lit("qu"), F.lit("kw"))).alias("b"))
    return rows.where(~F.col("a").eqNullSafe(F.col("b"))).select("doc_id")


@query("normalized_tokens", "SELECT page_id, '[BASE64] ' || lower(url) || ' [LONG]' AS tokens FROM pages")
def normalized_tokens(table):
    return table("pages").select("page_id", F.array_join(tokenize.normalized(F.array(F.lit("[BASE64]"), F.upper("url"), F.lit("[LONG]"))), " ").alias("tokens"))


@query("resplit_text", "SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(text, '[\\s\\p{Z}\\x{1c}-\\x{1f}\\x{85}]+'), lambda x: x <> ''), ' ')) AS text_md5 FROM documents")
def resplit_text(table):
    return table("documents").select("doc_id", F.md5(tokenize.resplit_text(F.split("text", " ", -1))).alias("text_md5"))


@query("split_documents")
def split_documents(table):
    return tokenize.split_texts(table("documents").select("doc_id", "text")).drop("text")


@query("page_tokens")
def page_tokens(table):
    return tokenize.tokenize_pages(table("pages")).select("page_id", "tokens", "error")


@query("linearized_pages")
def linearized_pages(table):
    return nodes.linearized(nodes.parsed(_snapshots(table)), "page_id")


@query("encoded_pages")
def encoded_pages(table):
    rows = tokenize.tokenize_pages(table("pages")).select("page_id", "tokens")
    return vocabulary.encode(rows, vocabulary.train(rows)).select("page_id", "tokenized")


@query("tokenization_diff")
def tokenization_diff(table):
    """Changes from a vocabulary of half the size to one of the whole: the former is the
    latter's first half, as its training takes the same steps."""
    rows = tokenize.tokenize_pages(table("pages")).select("page_id", "tokens")
    whole = vocabulary.train(rows)
    saved = vocabulary.encode(rows, whole[: vocabulary.DEFAULT_SIZE // 2]).select("page_id", "tokens", F.col("tokenized").alias("saved"))
    both = vocabulary.encode(saved, whole).withColumnRenamed("tokenized", "new")
    return diff.diff(both, "saved", "new", "page_id")


for _name, (_query, _sql) in CRAFTED.items():
    query(_name, _sql)(_query)
