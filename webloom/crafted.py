"""Queries over inputs whose right answer is known beforehand, so that SQL can write it down.

Snapshots are made of the parts table: two documents each, with a doctype, attributes, text,
comments, void elements and closings at several depths. Texts are made of known pieces, or
of documents' letters. The engine reads them as it reads any input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import diff, nodes, tokenize, vocabulary
from .operators.arrow import evened, spread
from .plans import jobs
from .schema import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, TEXT
from .sources import sinks, snapshots
from .streaming import tokens as streaming

STRINGS = (
    "concat('http://parts.test/', p_partkey)", "'#document'", "'html'", "'HTML'", "'BODY'", "'DIV'", "'class'", "p_type", "'#text'", "p_name",
    "'BR'", "'#comment'", "p_brand", "'IMG'", "'-//W3C//DTD XHTML//EN'", "'A'", "'href'", "concat('/p/', p_partkey)",
)
#: parent, type, name, value, attributes
FIRST = (
    (-1, DOCUMENT, 1, -1, ()), (0, DOCTYPE, 2, -1, ()), (0, ELEMENT, 3, -1, ()), (2, ELEMENT, 4, -1, ()), (3, ELEMENT, 5, -1, (6, 7)), (4, TEXT, 8, 9, ()),
    (4, ELEMENT, 10, -1, ()), (4, ELEMENT, 15, -1, (16, 17, 6, 12)), (7, COMMENT, 11, 12, ()),
)
SECOND = ((-1, DOCUMENT, 1, -1, ()), (0, ELEMENT, 13, -1, ()), (0, ELEMENT, 5, -1, ()), (2, TEXT, 8, 9, ()))


def _nodes(rows: tuple, more: str = "0") -> str:
    """The nodes' arrays; one part in three has a text in the body, one in three one after it."""
    columns = []
    for i, name in enumerate(nodes.ARRAYS):
        plain = i < 4
        one = [str(r[i]) if plain else f"cast(array({', '.join(map(str, r[i]))}) as array<int>)" for r in rows]
        last = ("3 - p_partkey % 3", str(TEXT), "8", "9", "cast(array() as array<int>)")[i]
        array = f"array({', '.join(one)})"
        columns.append(f"'{name}', if({more} = 1 and p_partkey % 3 < 2, array_append({array}, cast({last} as {'int' if plain else 'array<int>'})), {array})")
    return f"named_struct({', '.join(columns)})"


def crafted_snapshots(parts: DataFrame) -> DataFrame:
    """``source_index, displayed_url, dom_snapshot``; every other one is a browser's response."""
    document = lambda public, n: f"named_struct('documentURL', 0, 'publicId', {public}, 'systemId', -1, 'nodes', {n})"
    bare = f"to_json(named_struct('strings', array({', '.join(STRINGS)}), 'documents', array({document(14, _nodes(FIRST, '1'))}, {document(-1, _nodes(SECOND))})))"
    rows = spread(parts).select(F.col("p_partkey").cast("long").alias("source_index"), F.expr(STRINGS[0]).alias("displayed_url"), F.expr(bare).alias("dom_snapshot"))
    response = F.concat(F.lit('{"id":1,"result":'), "dom_snapshot", F.lit("}"))
    return rows.withColumn("dom_snapshot", F.when(F.col("source_index") % 2 == 0, response).otherwise(F.col("dom_snapshot")))


_BRAND = "replace(p_brand, '#', ' ')"
_EXPECTED = (
    "'<!DOCTYPE html PUBLIC W3C DTD XHTML EN > < html > < body > < div _ class = ' || p_type || ' > ' || p_name || ' < br > < a _ href = p ' || p_partkey || ' _ class = ' || "
    f"{_BRAND} || ' > <!-- ' || {_BRAND} || ' -->' || CASE p_partkey % 3 WHEN 0 THEN ' </ a > </ div > ' || p_name WHEN 1 THEN ' </ a > </ div > </ body > ' || p_name ELSE '' END || "
    "' < img > < div > ' || p_name || ' </ div >'"
)
EXPECTED = f"SELECT p_partkey AS source_index, {_EXPECTED} AS tokens FROM part"


def _spoken(df: DataFrame) -> DataFrame:
    return df.select("source_index", F.array_join("tokens", " ").alias("tokens"))


def snapshot_tokens(table) -> DataFrame:
    return _spoken(tokenize.tokenize_snapshots(crafted_snapshots(table("part"))))


def snapshot_relations(table) -> DataFrame:
    return _spoken(nodes.linearized(nodes.parsed(crafted_snapshots(table("part")))))


def _as_files(table) -> str:
    rows = crafted_snapshots(table("part"))
    path = sinks.scratch_path(rows.sparkSession, "snapshots")
    sinks.write_json_lines(rows, f"{path}/split=train")
    return path


def snapshot_files(table) -> DataFrame:
    """Written as lines of JSON, and the training split read again."""
    path = _as_files(table)
    return _spoken(tokenize.tokenize_snapshots(snapshots.read_snapshots(table("part").sparkSession, path)))


def snapshot_stream(table) -> DataFrame:
    """Written as files and read as a stream, whose sink is read again."""
    spark, path = table("part").sparkSession, f"{_as_files(table)}/split=train"
    out, state = sinks.scratch_path(spark, "stream-out"), sinks.scratch_path(spark, "stream-state")
    streaming.write_stream(streaming.stream_tokens(spark, path), out, state).awaitTermination()
    return _spoken(spark.read.parquet(out))


def snapshot_cache(table) -> DataFrame:
    """By way of the cache of lines, made and then read."""
    spark, path = table("part").sparkSession, _as_files(table)
    folder = sinks.scratch_path(spark, "cache")
    for _ in range(2):
        lines = snapshots.cached_lines(spark, path, folder, "train")
    return nodes.parsed(lines).select(F.get("strings", 0).alias("document_url"), F.get("strings", 9).alias("name"), F.size("documents").alias("n_documents"))


def snapshot_nodes(table) -> DataFrame:
    """The relation of nodes: how many of each type, with how many attributes, by document."""
    exploded = nodes.exploded(nodes.parsed(crafted_snapshots(table("part"))))
    return exploded.groupBy("source_index", "doc_index", "node_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("attrs")).alias("n_attributes"))


NODES_SQL = """
WITH n AS (SELECT p_partkey, unnest([[0, 9, 1, 0], [0, 10, 1, 0], [0, 1, 5, 3], [0, 3, 1 + (p_partkey % 3 < 2)::INTEGER, 0], [0, 8, 1, 0], [1, 9, 1, 0], [1, 1, 2, 0], [1, 3, 1, 0]]) AS n FROM part)
SELECT p_partkey AS source_index, n[1]::INTEGER AS doc_index, n[2]::INTEGER AS node_type, n[3]::BIGINT AS n, n[4]::BIGINT AS n_attributes FROM n
"""


def breaking_message(table) -> DataFrame:
    """What is said of the snapshots whose first node's parent was bent."""
    rows = crafted_snapshots(table("part"))
    rows = rows.withColumn("dom_snapshot", F.when(F.col("source_index") % 7 == 0, F.replace("dom_snapshot", F.lit('"parentIndex":[-1,0,0'), F.lit('"parentIndex":[-1,0,99'))).otherwise(F.col("dom_snapshot")))
    path = sinks.scratch_path(rows.sparkSession, "breaking")
    n = sinks.write_if_any(jobs.breaking(rows), path)
    found = rows.sparkSession.read.parquet(path).select("source_index") if n else rows.select("source_index").limit(0)
    return found.withColumn("message", F.lit(jobs.breaking_message(n)))


#: ``{w}`` and ``{v}`` are a row's words; what is split, how, and the tokens.
CASES = (
    ("full", r"{w}\x27s", "{w}'s"), ("full", r"{w}'s", "{w}'s"), ("full", r"A{w}", "A{w}"), ("full", r"{w}\n{v}", "{w} {v}"), ("full", r"{w}\t\r{v}", "{w} {v}"),
    ("full", r"{w}\"{v}", "{w} {v}"), ("full", r"{w}\'{v}", "{w}'{v}"), ("full", "{w}%20{v}", "{w} {v}"), ("full", "{w}%20%20{v}", "{w} {v}"), ("full", "%C3%A9{w}%C3%A9", "e{w}e"),
    ("full", "100% {w}", "100 {w}"), ("full", "{w}&apos;{v}", "{w}'{v}"), ("full", "{w}&nbsp;{v}", "{w} {v}"), ("full", "{w} &amp; {v}", "{w} {v}"), ("full", "&#65;{w}", "A{w}"),
    ("full", "&#x41;{w}", "A{w}"), ("full", "{w}_{v}", "{w} {v}"), ("full", "__{w}", "{w}"), ("full", "  {w}  {v}  ", "{w} {v}"), ("full", "{w}, {v}.", "{w} {v}"),
    ("full", "({w})-[{v}]", "{w} {v}"), ("full", "{w}'", "{w}"), ("full", "{w}'{v}", "{w}'{v}"), ("full", "é{w}ß", "e{w}ss"), ("full", "0xab12", "0x ab12"),
    ("full", "0xabcdef12", "0x [LONG] hex digits"), ("full", "{w} 12345678901", "{w} [LONG] digits"), ("full", "x" * 40, "[LONG] alphabetic"), ("full", "{w} 1234567", "{w} 1234567"),
    ("full", "iVBORw0KGgoAAAANSUhEUgAAAAUA", "[BASE64] png"), ("full", "eyJhIjogMSwgImIiOiBbMSwgMl19", "[BASE64] json"), ("full", "", ""), ("full", "...", ""), ("full", "{w}\\", "{w}"),
    ("basic", r"{w}\x27s", r"{w} x27s"), ("basic", "{w}%20{v}", "{w} 20{v}"), ("basic", "{W} {v}", "{W} {v}"), ("tag", "{W}", "{w}"), ("tag", "{W}-{v}", "{w} {v}"),
)
#: Words of letters beyond f, so that none is a hexadecimal number.
_TO = "translate(substr(md5('{0}' || {1}), 1, 8), '0123456789abcdef', 'ghijklmnopqrstuv')"


def _filled(template: Column) -> Column:
    for key, value in (("{w}", F.col("w")), ("{v}", F.col("v")), ("{W}", F.upper("w"))):
        template = F.replace(template, F.lit(key), value)
    return template


def split_cases(table) -> DataFrame:
    rows = spread(table("customer")).select("c_custkey", F.expr(_TO.format("w", "c_custkey")).alias("w"), F.expr(_TO.format("v", "c_custkey")).alias("v"))

    def split(mode: str) -> DataFrame:
        cases = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(text).alias("text")) for i, (of, text, _) in enumerate(CASES) if of == mode))
        made = rows.select("c_custkey", "w", "v", F.explode(cases).alias("c")).select("c_custkey", "c.place", _filled(F.col("c.text")).alias("text"))
        return tokenize.split_texts(made, mode=mode)

    return split("full").union(split("basic")).union(split("tag")).select("c_custkey", "place", F.array_join("tokens", " ").alias("tokens"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CASES_SQL = (
    "WITH c(place, want) AS (VALUES " + ", ".join(f"({i}, {_quoted(want)})" for i, (_, _, want) in enumerate(CASES)) + "), "
    f"r AS (SELECT c_custkey, {_TO.format('w', 'c_custkey')} AS w, {_TO.format('v', 'c_custkey')} AS v FROM customer) "
    "SELECT c_custkey, place::INTEGER AS place, replace(replace(replace(want, '{w}', w), '{v}', v), '{W}', upper(w)) AS tokens FROM r, c"
)

_PLAIN = "regexp_replace(regexp_replace(text, '[^A-Za-z ,.]+', ' '{0}), '([A-Za-z]{{22}})', '{1}1 '{0})"


#: ``[^A-Za-z ,.]`` by its ranges, which Java's expressions match several times faster.
_OTHERS = r"[\x00-\x1f!-+\-/-@\[-`{-\x{10ffff}]"


def _letters(table) -> DataFrame:
    """Whole documents, of which letters, commas and stops are left, words cut at 22 letters."""
    rows = evened(table("documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.regexp_replace(F.regexp_replace("text", f"{_OTHERS}+", " "), "([A-Za-z]{22})", "$1 ").alias("text"))


def _words(table) -> DataFrame:
    """``tokens``, the words of ``_letters``, found in one pass over the documents' own text."""
    rows = evened(table("documents").select("doc_id", "text"), "doc_id")
    return rows.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{1,22}"), F.lit(0)).alias("tokens"))


_PLAIN_SQL = (
    f"p AS (SELECT doc_id, {_PLAIN.format(', ' + _quoted('g'), chr(92))} AS text FROM documents), "
    "w AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: CASE WHEN regexp_matches(x, '^(?i)[0-9a-f]{8,}$') THEN '[LONG] hex digits' ELSE x END) AS w FROM p)"
)


def split_letters(table) -> DataFrame:
    tokens = tokenize.split_texts(_letters(table))
    return tokens.select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


LETTERS_SQL = f"WITH {_PLAIN_SQL} SELECT doc_id, coalesce(len(string_split(nullif(array_to_string(w, ' '), ''), ' ')), 0)::INTEGER AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM w"


def profile_tokens(table) -> DataFrame:
    """The profile of the tokenizer's own tokens."""
    return jobs.profile(tokenize.split_texts(_letters(table)), text="text").select("doc_id", "characters", "pre_tokens", "characters_per_token")


PROFILE_SQL = f"WITH {_PLAIN_SQL}, n AS (SELECT doc_id, length(text) AS c, coalesce(len(string_split(nullif(array_to_string(w, ' '), ''), ' ')), 0)::BIGINT AS n FROM w) SELECT doc_id, c AS characters, n AS pre_tokens, CASE WHEN n > 0 THEN c / n END AS characters_per_token FROM n"

#: A vocabulary that is given, for the greedy match.
GIVEN = ("[UNK]", *"abcdefghijklmnopqrstuvwxyz", *(f"##{c}" for c in "abcdefghijklmnopqrstuvw"), "th", "the", "in", "er", "ent", "##er", "##en", "##ing", "##tion", "##ch")
LONGEST = 6


def encoded_words(table) -> DataFrame:
    """Every distinct word by greedy longest match, [UNK] where a letter isn't in the vocabulary."""
    words = _letters(table).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("word")).distinct()
    made = vocabulary.encode(words.withColumn("tokens", F.array("word")), GIVEN)
    return made.select("word", F.array_join("tokenized", " ").alias("pieces"), F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


ENCODED_SQL = (
    f"WITH RECURSIVE {_PLAIN_SQL}, v(piece, id) AS (VALUES " + ", ".join(f"({_quoted(p)}, {i})" for i, p in enumerate(GIVEN)) + "), "
    "d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM p), "
    "s AS (SELECT word, 0 AS pos, []::VARCHAR[] AS pieces, []::INTEGER[] AS ids FROM d UNION ALL "
    "SELECT s.word, s.pos + b.k, list_append(s.pieces, b.piece), list_append(s.ids, b.id) FROM s, LATERAL (SELECT arg_max(k, k) AS k, arg_max(piece, k) AS piece, arg_max(id, k) AS id FROM "
    f"(SELECT k, v.piece, v.id FROM range(1, {LONGEST + 1}) r(k), v WHERE s.pos + k <= length(s.word) AND v.piece = CASE WHEN s.pos > 0 THEN '##' ELSE '' END || substr(s.word, s.pos + 1, k))) b WHERE s.pos < length(s.word) AND b.k IS NOT NULL), "
    "e AS (SELECT word, pieces, ids FROM s WHERE pos = length(word)) "
    "SELECT d.word, CASE WHEN e.word IS NULL THEN '[UNK]' ELSE array_to_string(e.pieces, ' ') END AS pieces, CASE WHEN e.word IS NULL THEN '0' ELSE array_to_string(e.ids, ' ') END AS ids FROM d LEFT JOIN e USING (word)"
)


def first_merge(table) -> DataFrame:
    """A trained vocabulary as far as the first merge: special tokens, the alphabet, one pair."""
    words = _words(table)
    made = vocabulary.train(words, len(vocabulary.BASE_TOKENS) + len(vocabulary.SPECIAL_TOKENS) + 53)
    given = len(vocabulary.BASE_TOKENS) + len(vocabulary.SPECIAL_TOKENS)
    letters = sum(len(t.removeprefix("##")) == 1 for t in made[given:])
    return words.sparkSession.createDataFrame(list(enumerate(made[: given + letters + 1])), "id int, token string")


MERGE_SQL = (
    f"WITH {_PLAIN_SQL}, t AS (SELECT lower(x) AS x, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM p) GROUP BY lower(x)), "
    "g AS (SELECT CASE WHEN i = 1 THEN '' ELSE '##' END || x[i] AS a, CASE WHEN i < length(x) THEN '##' || x[i + 1] END AS b, n FROM (SELECT x, n, unnest(range(1, length(x) + 1)) AS i FROM t)), "
    "l AS (SELECT a, sum(n) AS n FROM g GROUP BY a), m AS (SELECT a, b, sum(n) AS n FROM g WHERE b IS NOT NULL GROUP BY a, b ORDER BY n DESC, a, b LIMIT 1), "
    "o AS (SELECT 0 AS part, row_number() OVER () AS place, s AS token FROM (SELECT unnest(['[PAD]', '[UNK]', '[CLS]', '[SEP]', '[MASK]', '[BASE64]', '[LONG]']) AS s) "
    "UNION ALL SELECT 1, row_number() OVER (ORDER BY n DESC, a), a FROM l UNION ALL SELECT 2, 1, a || b[3:] FROM m) "
    "SELECT (row_number() OVER (ORDER BY part, place) - 1)::INTEGER AS id, token FROM o"
)


def saved_vocabulary(table) -> DataFrame:
    """The most frequent words as a vocabulary, saved, loaded and listed."""
    words = _words(table)
    spark, k = words.sparkSession, 200
    made = [r["token"] for r in vocabulary.most_frequent(vocabulary.token_counts(words), k).collect()]
    folder = sinks.scratch_path(spark, "vocabulary")
    vocabulary.save(spark, made, folder)
    loaded, meta = vocabulary.load(spark, folder)
    rows = spark.createDataFrame(list(enumerate(loaded)), "id int, token string")
    return rows.withColumn("model_max_length", F.lit(meta["model_max_length"]).cast("long"))


SAVED_SQL = f"WITH {_PLAIN_SQL}, c AS (SELECT x, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x FROM p) GROUP BY x) SELECT (row_number() OVER (ORDER BY n DESC, x) - 1)::INTEGER AS id, x AS token, 134217728::BIGINT AS model_max_length FROM c ORDER BY n DESC, x LIMIT 200"


def planted_changes(table) -> DataFrame:
    """Each document's distinct words, and the same with one replaced, put in, taken out, or
    changed in its continuation."""
    rows = _letters(table).select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w")).where("size(w) > 0")
    n, kind = F.floor((F.size("w") - 1) / 2).cast("int"), F.col("doc_id") % 4
    head, tail = F.slice(F.col("w"), F.lit(1), n), F.slice(F.col("w"), n + 2, F.size("w"))
    word = lambda *t: F.array(*map(F.lit, t))
    a = F.when(kind == 3, F.concat(head, word("kqx", "##z"), tail)).when(kind == 1, F.concat(head, tail)).otherwise(F.col("w"))
    b = F.when(kind == 3, F.concat(head, word("kqx", "##y"), tail)).when(kind == 2, F.concat(head, tail)).when(kind == 1, F.concat(head, word("kqxv"), tail)).otherwise(F.concat(head, word("kqxv"), tail))
    return diff.diff(rows.select("doc_id", a.alias("saved"), b.alias("new")), "saved", "new", "doc_id")


CHANGES_SQL = (
    f"WITH {_PLAIN_SQL}, e AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS x, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS i FROM p), "
    "f AS (SELECT doc_id, x, min(i) AS i FROM e GROUP BY doc_id, x), d AS (SELECT doc_id, list(x ORDER BY i) AS w FROM f GROUP BY doc_id), "
    "o AS (SELECT doc_id, w[(len(w) - 1) // 2 + 1] AS x FROM d) "
    "SELECT doc_id, 0 AS place, ['replace', 'insert', 'delete', 'replace'][doc_id % 4 + 1] AS op, CASE doc_id % 4 WHEN 0 THEN x WHEN 2 THEN x WHEN 3 THEN 'kqxz' END AS a, "
    "CASE doc_id % 4 WHEN 0 THEN 'kqxv' WHEN 1 THEN 'kqxv' WHEN 3 THEN 'kqxy' END AS b, NULL::VARCHAR AS error FROM o"
)


def change_lines(table) -> DataFrame:
    return diff.diff_lines(planted_changes(table), "doc_id").drop("at")


LINES_SQL = f"""WITH c AS ({CHANGES_SQL}) SELECT doc_id, place, unnest(list_filter([chr(27) || '[38;5;220m' || doc_id || ':' || chr(27) || '[0m', chr(27) || '[31m-' || a || chr(27) || '[0m', chr(27) || '[32m+' || b || chr(27) || '[0m'], lambda x: x IS NOT NULL)) AS line FROM c"""


def compact_rows(table) -> DataFrame:
    return table("nation").select("n_nationkey", sinks.compact_json("n_nationkey", "n_name", "n_regionkey").alias("json"))


COMPACT_SQL = """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation"""


def corpus_sizes(table) -> DataFrame:
    """What training says about the size of a corpus: its rows where they can be counted."""
    spark = table("pages").sparkSession
    said = [(name, jobs.corpus_message(1024, jobs.corpus_size(table(name)))) for name in ("pages", "part", "nation")]
    return spark.createDataFrame([*said, ("stream", jobs.corpus_message(1024, None))], "corpus string, message string")


SIZES_SQL = " UNION ALL ".join(f"SELECT '{t}' AS corpus, 'Generating up to 1,024 tokens from ' || format('{{:,}}', count(*)) || ' examples:' AS message FROM {t}" for t in ("pages", "part", "nation")) + " UNION ALL SELECT 'stream', 'Generating up to 1,024 tokens from an unknown number of examples:'"

CRAFTED = {
    "snapshot_tokens": (snapshot_tokens, EXPECTED),
    "snapshot_relations": (snapshot_relations, EXPECTED),
    "snapshot_files": (snapshot_files, EXPECTED),
    "snapshot_stream": (snapshot_stream, EXPECTED),
    "snapshot_cache": (snapshot_cache, "SELECT 'http://parts.test/' || p_partkey AS document_url, p_name AS name, 2 AS n_documents FROM part"),
    "snapshot_nodes": (snapshot_nodes, NODES_SQL),
    "breaking_message": (breaking_message, "WITH b AS (SELECT p_partkey FROM part WHERE p_partkey % 7 = 0) SELECT p_partkey AS source_index, 'Got ' || (SELECT count(*) FROM b) || ' breaking input' || CASE WHEN (SELECT count(*) FROM b) = 1 THEN '' ELSE 's' END AS message FROM b"),
    "split_cases": (split_cases, CASES_SQL),
    "split_letters": (split_letters, LETTERS_SQL),
    "profile_tokens": (profile_tokens, PROFILE_SQL),
    "encoded_words": (encoded_words, ENCODED_SQL),
    "first_merge": (first_merge, MERGE_SQL),
    "saved_vocabulary": (saved_vocabulary, SAVED_SQL),
    "planted_changes": (planted_changes, CHANGES_SQL),
    "change_lines": (change_lines, LINES_SQL),
    "compact_rows": (compact_rows, COMPACT_SQL),
    "corpus_sizes": (corpus_sizes, SIZES_SQL),
}
