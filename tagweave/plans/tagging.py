"""Queries of the tagging operators over texts, blocks, pages and places, with
their SQL.  Every query reads its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagweave.functions import features as ft
from tagweave.functions.text import default_tokens, label_key, natural_key, smart_join, substrings
from tagweave.operators import chains, cluster, domain, iob, markers, metrics, patterns, phrases, splits
from tagweave.operators.tokens import block_tokens, first_blocks, text_sequences, text_tokens, text_tokens_positions
from tagweave.session import table
from tagweave.sources import gazetteer
from tagweave.sources.gazetteer import build_lexicon, exploded_names

# ----------------------------------------------------------------------------- SQL pieces

_W = r"\t\n\x0b\f\r \x1c-\x1f\x{85}\p{Z}"


def _chain(x: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        x = f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', '{by}', 'g')"
    return x


_OPEN, _DQ, _SQ, _COMMA, _DOTS, _DOT, _DASH, _TICKS = (chr(0xE001 + i) for i in range(8))


def sql_tokens(text: str, keep_commas: bool = False) -> str:
    """List of word tokens in SQL without look-around: what must not split is
    hidden behind private-use signs first."""
    x = _chain(
        text,
        (rf'(^|[{_W}(\[{{<])"', rf"\1{_OPEN}"),
        ("''", _DQ),
        (rf"'([{_W}])", rf"{_SQ}\1"),
        (r",(\p{Nd})", rf"{_COMMA}\1"),
        (r"\.\.\.", _DOTS),
        ("…", _DOTS),
        (r"\.(\n?)$", rf"{_DOT}\1"),
        (rf"\.(\n{_OPEN})", rf"{_DOT}\1"),
        ("--", _DASH),
        ("``", _TICKS),
    )
    signs = rf";#$£%&|!?\[\](){{}}<>\"“”,{_OPEN}{_DQ}{_SQ}{_DOTS}{_DOT}{_DASH}{_TICKS}"
    cut = f"regexp_extract_all({x}, '[{signs}]|[^{_W}{signs}]+')"
    named = (
        f"list_transform({cut}, lambda t: CASE WHEN t IN ('{_OPEN}', '“', '{_TICKS}') THEN '``' WHEN t IN ('\"', '”', '{_DQ}') THEN '''''' WHEN t = '{_SQ}' THEN ''''"
        f" WHEN t = '{_DOTS}' THEN '...' WHEN t = '{_DOT}' THEN '.' WHEN t = '{_DASH}' THEN '--' ELSE replace(t, '{_COMMA}', ',') END)"
    )
    return named if keep_commas else f"list_filter({named}, lambda t: t <> ',' AND t <> ';')"


_TOK = f"""
tl AS (SELECT doc_id, {sql_tokens('text')} AS l FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, i - 1 AS pos, l[i] AS token FROM tl, unnest(range(1, len(l) + 1)) AS r(i))"""

#: Blocks of a page, each once, as token rows.
_BLK = """
fb AS (SELECT * FROM html_blocks QUALIFY row_number() OVER (PARTITION BY page_id, chunk_no ORDER BY block_id) = 1),
bl AS (SELECT page_id, chunk_no, is_tail, list_filter(list_zip(tokens, tags), lambda p: p[1] IS NOT NULL) AS z FROM fb WHERE tokens IS NOT NULL),
bb AS (SELECT *, len(z) AS block_len, coalesce(sum(len(z)) OVER (PARTITION BY page_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM bl),
bt AS (SELECT page_id AS doc_id, chunk_no, is_tail, block_len, i - 1 AS index, CAST(base + i - 1 AS BIGINT) AS pos, z[i][1] AS token, z[i][2] AS tag FROM bb, unnest(range(1, block_len + 1)) AS r(i))"""

_GRP = """
gp AS (SELECT *, coalesce(tag, 'O') AS t, lag(coalesce(tag, 'O')) OVER (PARTITION BY doc_id ORDER BY pos) AS prev FROM bt),
gn AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR t LIKE 'B%' OR (t = 'O' AND prev <> 'O') OR (t LIKE 'I%' AND (prev = 'O' OR substr(prev, 3) <> substr(t, 3))) THEN 1 ELSE 0 END)
         OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no,
         CASE WHEN t = 'O' THEN 'O' ELSE substr(t, 3) END AS group_type FROM gp)"""

_JOIN = r"""regexp_replace(regexp_replace(array_to_string({0}, ' '), ' ([,:;.!?")])', '\1', 'g'), '\( ', '(', 'g')"""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# ----------------------------------------------------------------------------- tokens


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def _tok(spark: SparkSession, sf: str) -> DataFrame:
    return text_tokens(_docs(spark, sf), "doc_id", "text")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return first_blocks(table(spark, sf, "html_blocks"), "page_id", "chunk_no", order="block_id")


def _bt(spark: SparkSession, sf: str) -> DataFrame:
    return block_tokens(_blocks(spark, sf), extra=("is_tail",))


@query(f"WITH tl AS (SELECT doc_id, {sql_tokens('text', True)} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, l[i] AS token FROM tl, unnest(range(1, len(l) + 1)) AS r(i)")
def tok_words(spark: SparkSession, sf: str) -> DataFrame:
    return text_tokens(_docs(spark, sf), "doc_id", "text", keep_commas=True)


@query(f"WITH {_TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM tok")
def tok_default(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf)


@query(f"WITH {_TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM tok")
def tok_positions_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the positional variant, by the same SQL."""
    return text_tokens_positions(_docs(spark, sf), "doc_id", "text").select("doc_id", "pos", "token")


@query("SELECT doc_id, CAST(0 AS BIGINT) AS wrong FROM documents WHERE text IS NOT NULL AND regexp_matches(text, '[^\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\p{Z},;]')")
def tok_positions_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens whose source slice isn't theirs: none in any document."""
    t = text_tokens_positions(_docs(spark, sf), "doc_id", "text").join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
    s = F.expr("substring(text, position + 1, length)")
    same = (s == F.col("token")) | F.col("token").isin("``", "''", "...")
    return t.groupBy("doc_id").agg(F.sum((~same).cast("long")).alias("wrong"))


@query("SELECT list_aggregate(list_transform(regexp_extract_all(c_name, '[0-9]+|[^0-9]+'), lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(ltrim(p, '0'), 20, '0') ELSE p END), 'string_agg', '') AS key, c_custkey FROM customer")
def natural_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(natural_key("c_name").alias("key"), "c_custkey")


@query("SELECT s_suppkey, s_name, 'Supplier#' || lpad(regexp_extract(s_name, '[0-9]+'), 20, '0') AS key FROM supplier")
def human_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers in natural order: a range-partitioned sort."""
    return splits.natural_order(table(spark, sf, "supplier").select("s_suppkey", "s_name", natural_key("s_name").alias("key")), "s_name")


@query("""WITH n AS (SELECT n_nationkey, n_name AS t, length(n_name) AS n FROM nation), s AS (
SELECT n_nationkey, i, k, substr(t, i, k) AS s, i = 1 AS a, i + k - 1 = n AS z FROM n, unnest(range(1, n + 1)) AS r(i), unnest(range(2, least(4, n - i + 1) + 1)) AS q(k)), p AS (
SELECT n_nationkey, s AS sub FROM s UNION ALL SELECT n_nationkey, '$' || s FROM s WHERE a UNION ALL SELECT n_nationkey, s || '$' FROM s WHERE z) SELECT n_nationkey, sub, count(*) AS n FROM p GROUP BY ALL""")
def substrings_pad(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.explode(substrings("n_name", 2, 4, "$")).alias("sub")).groupBy("n_nationkey", "sub").agg(F.count("*").alias("n"))


# ----------------------------------------------------------------------------- token features

_ISIN = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_WORD = r"[\p{L}\p{N}_]"
_SHAPE = rf"""CASE WHEN regexp_matches(token, '^(?:[-+]?[0-9]|\.[0-9]+$)') THEN 'number' WHEN regexp_full_match(token, '[^\p{{L}}\p{{N}}_]+') THEN 'punct'
 WHEN regexp_full_match(token, '[A-Z][a-z''`]+') THEN 'upcase' WHEN regexp_full_match(token, '[A-Z][A-Z''`]+') THEN 'caps' WHEN regexp_full_match(token, '[a-z]+') THEN 'downcase'
 WHEN regexp_full_match(token, '{_WORD}+') THEN 'mixedcase' ELSE 'other' END"""


@query(f"WITH {_TOK} SELECT {_SHAPE} AS shape, regexp_matches(token, '^\\p{{Lu}}') AS first_upper, count(*) AS n, count(DISTINCT token) AS n_tokens FROM tok GROUP BY 1, 2")
def feat_shape(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("token", *ft.apply([ft.token_shape], "token")).groupBy("shape", "first_upper").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_tokens"))


@query(f"""WITH {_TOK} SELECT DISTINCT token, lower(token) AS lower, 1 AS bias, token LIKE '%.' AND token <> '.' AS endswith_dot, token LIKE '%:' AND token <> ':' AS endswith_colon, contains(token, '©') AS has_copyright,
regexp_full_match(token, '(?:19|20)\\p{{Nd}}\\p{{Nd}}') AS looks_like_year, lower(token) IN {_ISIN(ft.MONTHS)} AS looks_like_month, lower(token) IN {_ISIN(ft.WEEKDAYS)} AS looks_like_weekday,
regexp_matches(token, '^\\p{{Nd}}{{1,2}}[.:]\\p{{Nd}}{{2}}') AS looks_like_time, lower(token) IN {_ISIN(ft.STREET_PARTS)} AS common_street_part, lower(token) IN {_ISIN(ft.ADDRESS_PARTS)} AS common_address_part,
lower(token) IN {_ISIN(ft.DIRECTIONS)} AS direction, lower(token) IN {_ISIN(ft.RANGES)} AS looks_like_range FROM tok""")
def feat_scalar_wide(spark: SparkSession, sf: str) -> DataFrame:
    tokens = _tok(spark, sf).select("token").distinct()
    builders = [ft.token_identity, ft.token_lower, ft.bias, ft.token_endswith_dot, ft.token_endswith_colon, ft.token_has_copyright, ft.looks_like_year, ft.looks_like_month, ft.looks_like_weekday, ft.looks_like_time, ft.looks_like_street_part, ft.looks_like_range]
    return tokens.select(*ft.apply(builders, "token"))


@query(f"""WITH {_TOK}, d AS (SELECT DISTINCT token, regexp_replace(token, '\\p{{Nd}}', 'X', 'g') AS x FROM tok)
SELECT token, x AS num_pattern, regexp_replace(regexp_replace(replace(x, 'X', '{chr(0xE001)}'), '{_WORD}', 'C', 'g'), '{chr(0xE001)}', 'X', 'g') AS num_pattern2 FROM d
WHERE length(regexp_replace(token, '[^\\p{{Nd}}]', '', 'g')) >= length(token) * 0.3""")
def feat_number_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("token").distinct().select("token", *ft.apply([ft.number_pattern], "token")).where("num_pattern IS NOT NULL")


@query(f"WITH {_TOK}, d AS (SELECT DISTINCT token, lower(token) AS l FROM tok) SELECT token, " + ", ".join(f"left(l, {k}) AS prefix{k}, right(l, {k}) AS suffix{k}" for k in (2, 3, 4)) + " FROM d")
def feat_affixes(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("token").distinct().select("token", *ft.apply([ft.prefixes_and_suffixes], "token"))


@query(f"WITH {_TOK}, d AS (SELECT DISTINCT token FROM tok) SELECT token, left(token, 1) AS head1, right(token, 5) AS end5 FROM d")
def feat_affixes_custom(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).select("token").distinct().select("token", *ft.apply([ft.prefixes((1,), "head", lower=False), ft.suffixes((5,), "end", lower=False)], "token"))


@query(f"""WITH {_TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token FROM tok WHERE regexp_matches(token,
 '(?i)(?:^|%20|[^\\p{{L}}\\p{{N}}_]){_WORD}[\\p{{L}}\\p{{N}}_.\\-]*@{_WORD}[\\p{{L}}\\p{{N}}_.\\-]*\\.(?:{ft.ZONES})(?:[^\\p{{L}}\\p{{N}}_]|$)')""")
def feat_email(spark: SparkSession, sf: str) -> DataFrame:
    return _tok(spark, sf).where(ft.looks_like_email(F.col("token"))["looks_like_email"])


@query(f"""WITH {_BLK} SELECT doc_id, pos, token, index = 0 AS border_at_left, index = block_len - 1 AS border_at_right,
CASE WHEN block_len = 1 THEN '1' WHEN block_len <= 10 THEN 'short' WHEN block_len <= 20 THEN 'medium' ELSE 'large' END AS block_length FROM bt""")
def feat_borders_block(spark: SparkSession, sf: str) -> DataFrame:
    t = _bt(spark, sf)
    named = {**ft.borders(F.col("index"), F.col("block_len")), **ft.block_length(F.col("block_len"))}
    return t.select("doc_id", "pos", "token", *[c.alias(n) for n, c in named.items()])


@query(f"WITH {_TOK} SELECT DISTINCT token, CASE WHEN token LIKE '%.' AND token <> '.' THEN '1' ELSE '0' END AS dot, '1' AS bias, coalesce(CASE WHEN length(regexp_replace(token, '[^\\p{{Nd}}]', '', 'g')) >= length(token) * 0.3 THEN regexp_replace(token, '\\p{{Nd}}', 'X', 'g') END, 'None') AS num FROM tok")
def feat_to_str(spark: SparkSession, sf: str) -> DataFrame:
    from tagweave.functions.text import to_str

    t = _tok(spark, sf).select("token").distinct().select("token", *ft.apply([ft.token_endswith_dot, ft.bias, ft.number_pattern], "token"))
    return t.select("token", to_str(F.col("endswith_dot"), "boolean").alias("dot"), to_str(F.col("bias"), "int").alias("bias"), to_str(F.col("num_pattern"), "string").alias("num"))


# ----------------------------------------------------------------------------- neighbourhood


@query(f"""WITH {_TOK}, f AS (SELECT doc_id, pos, lower(token) AS l FROM tok), g AS (SELECT doc_id, pos, l, lag(l) OVER w AS p1, lag(l, 2) OVER w AS p2, lead(l) OVER w AS n1 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, p1 AS prev, n1 AS next, CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN coalesce(p2, '?') || '/' || coalesce(p1, '?') END AS bigram FROM g""")
def pattern_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    t = _tok(spark, sf).select("doc_id", "pos", F.lower("token").alias("lower"))
    for parts, name in (([(-1, "lower")], "prev"), ([(1, "lower")], "next"), ([(-2, "lower"), (-1, "lower")], "bigram")):
        t = patterns.pattern(t, parts, name=name)
    return t.select("doc_id", "pos", "prev", "next", "bigram")


@query(f"""WITH {_TOK}, f AS (SELECT doc_id, pos, {_SHAPE} AS s, CASE WHEN length(regexp_replace(token, '[^\\p{{Nd}}]', '', 'g')) >= length(token) * 0.3 THEN regexp_replace(token, '\\p{{Nd}}', 'X', 'g') END AS np FROM tok),
g AS (SELECT doc_id, pos, s, coalesce(np, '_NA_') AS np, lag(s) OVER w AS p1, lag(s, 2) OVER w AS p2 FROM f WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
SELECT CASE WHEN p1 IS NOT NULL OR p2 IS NOT NULL THEN coalesce(p1, '?') || '/' || coalesce(p2, '?') END AS shapes, s || '/' || np AS here, count(*) AS n FROM g GROUP BY 1, 2""")
def pattern_shapes(spark: SparkSession, sf: str) -> DataFrame:
    t = _tok(spark, sf).select("doc_id", "pos", *ft.apply([ft.token_shape, ft.number_pattern], "token"))
    t = patterns.pattern(t, [(-1, "shape"), (-2, "shape")], name="shapes")
    t = patterns.pattern(t, [(0, "shape"), (0, "num_pattern")], name="here")
    return t.groupBy("shapes", "here").agg(F.count("*").alias("n"))


_LONG = f"lf AS (SELECT doc_id, 'lower' AS name, lower(token) AS value FROM tok UNION ALL SELECT doc_id, 'shape', {_SHAPE} FROM tok UNION ALL SELECT doc_id, 'suffix3', right(lower(token), 3) FROM tok)"


def _long(spark: SparkSession, sf: str) -> DataFrame:
    t = _tok(spark, sf).select("doc_id", "pos", *ft.apply([ft.token_lower, ft.token_shape, ft.suffixes((3,))], "token"))
    return patterns.long_features(t, ["lower", "shape", "suffix3"])


@query(f"WITH {_TOK}, {_LONG} SELECT name, value, count(DISTINCT doc_id) AS df FROM lf GROUP BY 1, 2")
def df_counts(spark: SparkSession, sf: str) -> DataFrame:
    return patterns.document_frequency(_long(spark, sf))


@query(f"WITH {_TOK}, {_LONG}, k AS (SELECT name, value FROM lf GROUP BY 1, 2 HAVING count(DISTINCT doc_id) >= 3) SELECT name, count(*) AS n_cells, count(DISTINCT value) AS n_values FROM lf JOIN k USING (name, value) GROUP BY 1")
def df_prune(spark: SparkSession, sf: str) -> DataFrame:
    kept = patterns.pair_counts(_long(spark, sf)).where("df >= 3")
    return kept.groupBy("name").agg(F.sum("cells").alias("n_cells"), F.count("*").alias("n_values"))


@query(f"WITH {_TOK}, {_LONG} SELECT DISTINCT name FROM lf")
def feature_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return _long(spark, sf).select("name").distinct()


@query(f"""WITH {_TOK} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token || ' ' || CASE WHEN token LIKE '%.' AND token <> '.' THEN '1' ELSE '0' END || ' ' || coalesce(CASE WHEN length(regexp_replace(token, '[^\\p{{Nd}}]', '', 'g')) >= length(token) * 0.3 THEN regexp_replace(token, '\\p{{Nd}}', 'X', 'g') END, 'None') AS line FROM tok""")
def wapiti_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = _tok(spark, sf).select("doc_id", "pos", *ft.apply([ft.token_identity, ft.token_endswith_dot, ft.number_pattern], "token"))
    return patterns.feature_lines(t, ["token", "endswith_dot", "num_pattern"])


@query(f"""WITH {_BLK} SELECT doc_id, string_agg(token || ' ' || CASE WHEN index = 0 THEN '1' ELSE '0' END || ' ' || coalesce(tag, 'O'), chr(10) ORDER BY pos) AS block FROM bt GROUP BY 1""")
def wapiti_training_file(spark: SparkSession, sf: str) -> DataFrame:
    t = _bt(spark, sf).select("doc_id", "pos", "token", (F.col("index") == 0).alias("first"), F.coalesce("tag", F.lit("O")).alias("tag"))
    return patterns.training_lines(t, ["token", "first"])


# ----------------------------------------------------------------------------- IOB

#: Documents with their addresses marked: a stream of markers for the encoder.
_MARK = r"regexp_replace(text, '([A-Za-z0-9][A-Za-z0-9.+_-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})', ' __START_EMAIL__ \1 __END_EMAIL__ ', 'g')"


def _marked(spark: SparkSession, sf: str) -> DataFrame:
    pattern = r"([A-Za-z0-9][A-Za-z0-9.+_-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    return _docs(spark, sf).select("doc_id", F.regexp_replace("text", pattern, " __START_EMAIL__ $1 __END_EMAIL__ ").alias("text"))


@query(f"""WITH tl AS (SELECT doc_id, {sql_tokens(_MARK)} AS l FROM documents WHERE text IS NOT NULL), tok AS (SELECT doc_id, i AS pos, l[i] AS token FROM tl, unnest(range(1, len(l) + 1)) AS r(i)),
c AS (SELECT *, regexp_extract(token, '^__(START|END)_', 1) AS kind FROM tok), o AS (SELECT *, sum(CASE WHEN kind = 'START' THEN 1 WHEN kind = 'END' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS depth, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM c)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS INTEGER) AS pos, token, CASE WHEN depth = 0 THEN 'O' WHEN before = 'START' THEN 'B-EMAIL' ELSE 'I-EMAIL' END AS tag FROM o WHERE kind = ''""")
def iob_encode(spark: SparkSession, sf: str) -> DataFrame:
    return iob.encode(text_tokens(_marked(spark, sf), "doc_id", "text"))


@query(f"WITH {_BLK}, {_GRP} SELECT doc_id, group_no, any_value(group_type) AS tag, min(pos) AS start_pos, max(pos) AS end_pos, array_to_string(list(token ORDER BY pos), ' ') AS tokens FROM gn GROUP BY 1, 2")
def iob_group(spark: SparkSession, sf: str) -> DataFrame:
    return iob.groups(_bt(spark, sf)).select("doc_id", "group_no", "tag", "start_pos", "end_pos", F.array_join("tokens", " ").alias("tokens"))


_DAMAGED = "CASE WHEN tag LIKE 'B-%' AND pos % 3 = 0 THEN 'I-' || substr(tag, 3) WHEN pos % 11 = 5 THEN 'O' ELSE tag END"


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated blocks with a second, worse tagging made by rule."""
    t = _bt(spark, sf).where("tag IS NOT NULL")
    worse = F.when(F.col("tag").startswith("B-") & (F.col("pos") % 3 == 0), F.concat(F.lit("I-"), F.substring("tag", 3, 1000))).when(F.col("pos") % 11 == 5, "O").otherwise(F.col("tag"))
    return t.select("doc_id", "pos", "token", F.col("tag").alias("y_true"), worse.alias("y_pred"))


@query(f"WITH {_BLK.replace('AS tag FROM bb', 'AS tag0 FROM bb')}".replace("bt AS (", "bt0 AS (") + f", bt AS (SELECT doc_id, pos, token, {_DAMAGED.replace('tag', 'tag0')} AS tag FROM bt0 WHERE tag0 IS NOT NULL), {_GRP} SELECT group_type AS tag, count(DISTINCT (doc_id, group_no)) AS n_groups, count(*) AS n_tokens FROM gn GROUP BY 1")
def iob_group_repair(spark: SparkSession, sf: str) -> DataFrame:
    n = iob.number_groups(_predicted(spark, sf), "y_pred")
    return n.groupBy(F.col("group_type").alias("tag")).agg(F.countDistinct("doc_id", "group_no").alias("n_groups"), F.count("*").alias("n_tokens"))


@query(f"WITH {_BLK}, {_GRP}, e AS (SELECT doc_id, group_no, any_value(group_type) AS entity_type, {_JOIN.format('list(token ORDER BY pos)')} AS text, min(pos) AS start_pos, max(pos) AS end_pos FROM gn WHERE group_type <> 'O' GROUP BY 1, 2) SELECT * FROM e WHERE text <> ''")
def smart_join_entities(spark: SparkSession, sf: str) -> DataFrame:
    return iob.entities(_bt(spark, sf))


@query(f"WITH {_TOK} SELECT doc_id, {_JOIN.format('list(token ORDER BY pos)')} AS text FROM tok GROUP BY 1")
def smart_join_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", smart_join(default_tokens("text")).alias("text")).where("text <> ''")


@query(f"WITH {_BLK} SELECT DISTINCT tag FROM bt WHERE tag <> 'O'")
def tag_labels(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.labels(_bt(spark, sf), "tag")


@query(f"WITH {_BLK}, d AS (SELECT DISTINCT tag FROM bt WHERE tag <> 'O') SELECT tag, CAST(row_number() OVER (ORDER BY substr(tag, 3) || '-' || left(tag, 1)) AS INTEGER) AS place FROM d")
def label_order(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    d = metrics.labels(_bt(spark, sf), "tag")  # a few labels
    return d.select("tag", F.row_number().over(Window.orderBy(label_key("tag"))).alias("place"))


# ----------------------------------------------------------------------------- markers


@query(r"""SELECT block_id, regexp_replace(regexp_replace('<ORG>' || coalesce(elem, '') || '</org><CITY class=x>', '(?i)<(ORG|CITY|STRONG)>', ' __START_\1__ ', 'g'), '(?i)</(ORG|CITY|STRONG)>', ' __END_\1__ ', 'g') AS text FROM html_blocks""")
def gate_markers(spark: SparkSession, sf: str) -> DataFrame:
    html = F.concat(F.lit("<ORG>"), F.coalesce("elem", F.lit("")), F.lit("</org><CITY class=x>"))
    return table(spark, sf, "html_blocks").select("block_id", markers.inline_tags_to_markers(html, ["ORG", "CITY", "STRONG"]).alias("text"))


@query(rf"SELECT doc_id, regexp_replace(regexp_replace({_MARK}, '(^|\s)__(START|END)_(\w+?)__(\s|$)', '', 'g'), '^x$', 'x') AS text FROM documents")
def marker_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", markers.remove_markers(F.col("text")).alias("text"))


@query(rf"""WITH m AS (SELECT doc_id, {_MARK} AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, regexp_extract_all(t, '__(?:START|END)_\w+?__') AS k, regexp_split_to_array(t, '__(?:START|END)_\w+?__') AS b FROM m)
SELECT doc_id, regexp_extract(k[i], '__(START|END)_', 1) AS kind, regexp_extract(k[i], '__(?:START|END)_(\w+?)__', 1) AS type, CAST(coalesce(list_sum(list_transform(b[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(k[1:i-1], lambda s: length(s))), 0) AS INTEGER) AS position FROM x, unnest(range(1, len(k) + 1)) AS r(i)""")
def marker_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _marked(spark, sf).select("doc_id", F.inline(markers.find_markers(F.col("text"))))


@query(rf"""WITH m AS (SELECT doc_id, {_MARK} AS t FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, regexp_extract_all(t, '__(?:START|END)_\w+?__') AS k, regexp_split_to_array(t, '__(?:START|END)_\w+?__') AS b FROM m),
p AS (SELECT doc_id, k[i] AS mk, CAST(coalesce(list_sum(list_transform(b[1:i], lambda s: length(s))), 0) + coalesce(list_sum(list_transform(k[1:i-1], lambda s: length(s))), 0) AS INTEGER) AS at, row_number() OVER (PARTITION BY doc_id, left(k[i], 5) ORDER BY i) AS k FROM x, unnest(range(1, len(k) + 1)) AS r(i))
SELECT s.doc_id, CAST(s.k AS INTEGER) AS k, 'EMAIL' AS type, s.at AS "start", e.at AS "end" FROM p s JOIN p e ON s.doc_id = e.doc_id AND s.k = e.k AND s.mk LIKE '\_\_START%' ESCAPE '\' AND e.mk LIKE '\_\_END%' ESCAPE '\'""")
def marker_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = _marked(spark, sf).select("doc_id", F.inline(markers.find_markers(F.col("text")))).withColumnRenamed("position", "at")
    return markers.pair_markers(found)


@query(rf"""SELECT doc_id, {_MARK} AS text FROM documents""")
def detokenize_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses found as tokens and marked in the text by position equal the
    texts marked directly: tokens are tagged by whether their slice lies in an
    address."""
    docs = _docs(spark, sf)
    pattern = r"[A-Za-z0-9][A-Za-z0-9.+_-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    pieces = F.split("text", pattern)
    hits = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    at = lambda i: F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice(hits, 1, i), F.lit(0), lambda a, x: a + F.length(x))
    spans = docs.where("text IS NOT NULL").select("doc_id", F.inline(F.transform(hits, lambda h, i: F.struct(i.alias("pos"), at(i).cast("int").alias("position"), F.length(h).alias("length"), F.lit("B-EMAIL").alias("tag")))))
    return markers.insert_markers(docs, spans.withColumn("token", F.lit("")))


@query("SELECT block_id, CASE regexp_extract(elem, '^<([a-z0-9]+)', 1) WHEN 'h1' THEN 'h3' WHEN 'h2' THEN 'h3' ELSE regexp_extract(elem, '^<([a-z0-9]+)', 1) END AS tag FROM html_blocks WHERE elem IS NOT NULL")
def replace_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "html_blocks").where("elem IS NOT NULL")
    return t.select("block_id", markers.replace_tags(F.regexp_extract("elem", r"\A<([a-z0-9]+)", 1), {"h1": "h3", "h2": "h3"}).alias("tag"))


# ----------------------------------------------------------------------------- lexicons

_LEX = "lex AS (SELECT DISTINCT name FROM place_names UNION SELECT 'the ' || lower(r_name) FROM region UNION SELECT 'stays open' UNION SELECT 'open in all weather' UNION SELECT 'in all')"


def _lexicon(spark: SparkSession, sf: str) -> DataFrame:
    fixed = spark.sql("SELECT explode(array('stays open', 'open in all weather', 'in all')) AS name")
    regions = table(spark, sf, "region").select(F.concat(F.lit("the "), F.lower("r_name")).alias("name"))
    return table(spark, sf, "place_names").select("name").unionByName(regions).unionByName(fixed).distinct()


_MATCH = f"""{_LEX}, ln AS (SELECT DISTINCT len(string_split(name, ' ')) AS k FROM lex), sq AS (SELECT doc_id, list(token ORDER BY pos) AS l FROM tok GROUP BY 1),
sp AS (SELECT doc_id, i - 1 AS s, i - 1 + k AS e, array_to_string(l[i : i + k - 1], ' ') AS phrase FROM sq, ln, unnest(range(1, len(l) - k + 2)) AS r(i)),
mt AS (SELECT doc_id, s, max(e) AS e, arg_max(phrase, e) AS phrase FROM sp JOIN lex ON phrase = name GROUP BY 1, 2)"""


@query(f"WITH {_TOK}, {_MATCH} SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", phrase FROM mt")
def gaz_matches(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.find_matches(text_sequences(_docs(spark, sf), "doc_id", "text"), _lexicon(spark, sf))


# greedy, longest first: a match is dropped iff a kept one overlaps it; lengths are few, so one step a length
_GREEDY = f"""{_MATCH}, r4 AS (SELECT * FROM mt WHERE e - s >= 4), r3 AS (SELECT * FROM mt m WHERE e - s = 3 AND NOT EXISTS (SELECT 1 FROM r4 k WHERE k.doc_id = m.doc_id AND k.s < m.e AND m.s < k.e)),
a3 AS (SELECT * FROM r4 UNION ALL SELECT * FROM r3), r2 AS (SELECT * FROM mt m WHERE e - s = 2 AND NOT EXISTS (SELECT 1 FROM a3 k WHERE k.doc_id = m.doc_id AND k.s < m.e AND m.s < k.e)),
a2 AS (SELECT * FROM a3 UNION ALL SELECT * FROM r2), r1 AS (SELECT * FROM mt m WHERE e - s = 1 AND NOT EXISTS (SELECT 1 FROM a2 k WHERE k.doc_id = m.doc_id AND k.s < m.e AND m.s < k.e)), kept AS (SELECT * FROM a2 UNION ALL SELECT * FROM r1)"""


@query(f"WITH {_TOK}, {_GREEDY} SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS \"end\", phrase FROM kept")
def gaz_longest_match(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.longest_matches(text_sequences(_docs(spark, sf), "doc_id", "text"), _lexicon(spark, sf))


@query(f"""WITH {_TOK}, {_GREEDY} SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, pos = s AS "B-PLACE", pos > s AS "I-PLACE" FROM tok JOIN kept USING (doc_id) WHERE pos >= s AND pos < e""")
def gaz_bio_flags(spark: SparkSession, sf: str) -> DataFrame:
    f = phrases.phrase_flags(_tok(spark, sf), _lexicon(spark, sf), "PLACE").where("PLACE")
    no = F.lit(False)
    return f.select("doc_id", "pos", "token", F.coalesce("`B-PLACE`", no).alias("B-PLACE"), F.coalesce("`I-PLACE`", no).alias("I-PLACE"))


_LOWER = _GREEDY.replace("list(token ORDER BY pos)", "list(lower(token) ORDER BY pos)").replace("FROM sp JOIN lex ON phrase = name", "FROM sp JOIN (SELECT DISTINCT lower(name) AS name FROM lex) AS low ON phrase = low.name")


@query(f"WITH {_TOK}, {_LOWER} SELECT doc_id, count(*) AS n_places, CAST(sum(e - s) AS BIGINT) AS n_tokens FROM kept GROUP BY 1")
def gaz_lower(spark: SparkSession, sf: str) -> DataFrame:
    """Places and their tokens in each document, case disregarded."""
    seqs = text_sequences(_docs(spark, sf), "doc_id", "text").withColumn("tokens", F.transform("tokens", F.lower))
    found = phrases.longest_matches(seqs, _lexicon(spark, sf).select(F.lower("name").alias("name")))
    return found.groupBy("doc_id").agg(F.count("*").alias("n_places"), F.sum(F.col("end") - F.col("start")).alias("n_tokens"))


_CUT = "string_split(raw_line, chr(9))"


@query(f"SELECT raw_id, CASE WHEN regexp_full_match(x[1], '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim(x[1]) AS BIGINT) END AS geonameid, nullif(x[2], '') AS main_name, nullif(x[9], '') AS country_code, CASE WHEN regexp_full_match(x[15], '\\s*[+-]?[0-9]+\\s*') THEN TRY_CAST(trim(x[15]) AS BIGINT) END AS population, CASE WHEN n <> 19 THEN raw_line END AS bad FROM (SELECT raw_id, raw_line, len({_CUT}) AS n, CASE WHEN len({_CUT}) = 19 THEN {_CUT} ELSE [] END AS x FROM geonames_raw)")
def gazetteer_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the dump with quotes as plain characters, bad ones apart."""
    raw = table(spark, sf, "geonames_raw").select("raw_id", "raw_line")
    return gazetteer.cut_lines(raw, carry=("raw_id",)).select("raw_id", "geonameid", "main_name", "country_code", "population", F.col("_bad").alias("bad"))


@query(f"WITH {_BLK}, n AS (SELECT doc_id, pos, max(pos) OVER (PARTITION BY doc_id) - pos AS back, token, coalesce(tag, 'O') AS tag FROM bt) SELECT doc_id, back AS pos, token, tag FROM n WHERE pos % 2 = 0")
def iob_from_indices(spark: SparkSession, sf: str) -> DataFrame:
    """Every second tagged token, gathered by its index in reverse order."""
    t = _bt(spark, sf).withColumn("tag", F.coalesce("tag", F.lit("O")))
    last = t.groupBy("doc_id").agg(F.max("pos").alias("last"))
    picked = t.where("pos % 2 = 0").join(last, "doc_id").select("doc_id", (F.col("last") - F.col("pos")).alias("out_pos"), "pos", "tag")
    return iob.from_indices(picked, iob.split(t)[0])


_NAMES = "list_distinct(list_filter(string_split(concat_ws(',', main_name, asciiname, alternatenames), ','), lambda n: n <> ''))"


@query(f"SELECT row_id, geonameid, unnest({_NAMES}) AS name FROM geonames")
def geonames_explode(spark: SparkSession, sf: str) -> DataFrame:
    return exploded_names(table(spark, sf, "geonames"), "row_id", "geonameid")


@query(f"WITH n AS (SELECT country_code, feature_code, lower(unnest({_NAMES})) AS name FROM geonames WHERE feature_code IN ('ADM1', 'ADM2', 'ADM3', 'ADM4')) SELECT DISTINCT name, CAST(len(string_split(name, ' ')) AS INTEGER) AS n_words, country_code, feature_code FROM n")
def gazetteer_build(spark: SparkSession, sf: str) -> DataFrame:
    return build_lexicon(table(spark, sf, "geonames"), ("country_code", "feature_code"), ("ADM1", "ADM2", "ADM3", "ADM4"), lower=True)


# ----------------------------------------------------------------------------- clustering

_POS = f"""{_BLK}, pl AS (SELECT *, chunk_no AS node, CASE WHEN is_tail THEN -1 ELSE chunk_no END AS parent FROM bt WHERE tag IS NOT NULL),
pp AS (SELECT *, lag(node) OVER w AS n0, lag(parent) OVER w AS p0, lag(pos) OVER w AS first FROM pl WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
pq AS (SELECT *, CAST(-5 + sum(2 + CASE WHEN first IS NULL OR p0 <> parent THEN 2 ELSE 0 END + CASE WHEN first IS NULL OR n0 <> node THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS place FROM pp)"""
_DIST = f"""{_POS}, {_GRP.replace('FROM bt)', 'FROM pq)')}, en AS (SELECT doc_id, group_no, any_value(group_type) AS entity_type, min(place) AS a, max(place) AS b, list(token ORDER BY pos) AS toks FROM gn WHERE group_type <> 'O' GROUP BY 1, 2),
ed AS (SELECT doc_id, CAST(row_number() OVER w AS INTEGER) AS ent_no, entity_type, toks, a, b, a - lag(b, 1, 0) OVER w AS dist FROM en WINDOW w AS (PARTITION BY doc_id ORDER BY group_no))"""
_EXEMPT = "('TEL', 'FAX')"
_SCORE = f"""{_DIST}, cand AS (SELECT DISTINCT doc_id, dist AS t FROM ed WHERE ent_no > 1), cl AS (SELECT ed.doc_id, t, ent_no, entity_type, sum(CASE WHEN ent_no > 1 AND dist > t THEN 1 ELSE 0 END) OVER (PARTITION BY ed.doc_id, t ORDER BY ent_no ROWS UNBOUNDED PRECEDING) AS c FROM ed JOIN cand USING (doc_id)),
cc AS (SELECT doc_id, t, c, entity_type, count(*) AS n FROM cl GROUP BY ALL), c1 AS (SELECT doc_id, t, c, sum(CASE WHEN n = 1 OR entity_type IN {_EXEMPT} THEN n ELSE -n END) - 1 AS s FROM cc GROUP BY ALL),
sc AS (SELECT doc_id, CAST(t AS BIGINT) AS threshold, CAST(sum(s) AS BIGINT) AS score FROM c1 GROUP BY ALL UNION ALL SELECT doc_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM ed GROUP BY doc_id HAVING count(*) = 1)"""
_EX = frozenset({"TEL", "FAX"})


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    t = _bt(spark, sf).where("tag IS NOT NULL").withColumn("node_id", F.col("chunk_no")).withColumn("parent_node_id", F.when(F.col("is_tail"), -1).otherwise(F.col("chunk_no")))
    return cluster.positions(t)


@query(f"WITH {_POS} SELECT doc_id, pos, place FROM pq")
def cluster_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _placed(spark, sf).select("doc_id", "pos", "place")


@query(f"WITH {_DIST} SELECT doc_id, ent_no, entity_type, a AS start_place, b AS end_place, dist AS distance FROM ed")
def cluster_distance(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.entity_distances(_placed(spark, sf)).drop("tokens")


@query(f"WITH {_DIST} SELECT doc_id, ent_no, CAST(1 + sum(CASE WHEN ent_no > 1 AND dist > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ent_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no FROM ed")
def cluster_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.at_threshold(cluster.entity_distances(_placed(spark, sf)), 7).select("doc_id", "ent_no", "cluster_no")


@query(f"WITH {_SCORE} SELECT doc_id, threshold, score FROM sc")
def cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.scores(cluster.entity_distances(_placed(spark, sf)), _EX)


@query(f"WITH {_SCORE} SELECT doc_id, threshold, score FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, threshold DESC) = 1")
def cluster_best(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.best(cluster.entity_distances(_placed(spark, sf)), _EX)


@query(f"""WITH {_SCORE}, bs AS (SELECT doc_id, threshold AS t FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, threshold DESC) = 1),
gg AS (SELECT doc_id, CAST(1 + sum(CASE WHEN ent_no > 1 AND dist > t THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ent_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster_no, ent_no, entity_type, {_JOIN.format('toks')} AS text FROM ed JOIN bs USING (doc_id)) SELECT * FROM gg WHERE text <> ''""")
def entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.entity_groups(_placed(spark, sf), _EX)


# ----------------------------------------------------------------------------- metrics

_PRED = f"{_BLK}, yy AS (SELECT doc_id, pos, tag AS y_true, {_DAMAGED} AS y_pred FROM bt WHERE tag IS NOT NULL)"
_SEG = "SELECT doc_id, min(CASE WHEN {0} LIKE 'B%' THEN pos END) AS start, arg_min({0}, pos) AS tag, count(*) AS n FROM (SELECT *, sum(CASE WHEN {0} LIKE 'B%' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no FROM yy) WHERE {0} <> 'O' AND no > 0 GROUP BY doc_id, no"
_F1 = f"""{_PRED}, g AS ({_SEG.format('y_true')}), p AS ({_SEG.format('y_pred')}), b AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.start IS NOT NULL AS ig, p.start IS NOT NULL AS ip FROM g FULL JOIN p ON g.doc_id = p.doc_id AND g.start = p.start AND g.tag = p.tag AND g.n = p.n),
k AS (SELECT doc_id, count(*) FILTER (ig AND ip) AS tp, count(*) FILTER (ip AND NOT ig) AS fp, count(*) FILTER (ig AND NOT ip) AS fn FROM b GROUP BY 1),
f AS (SELECT d.doc_id, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, CASE WHEN coalesce(tp, 0) = 0 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * tp / (2.0::DOUBLE * tp + fp + fn), 6) END AS f1 FROM (SELECT DISTINCT doc_id FROM yy) d LEFT JOIN k USING (doc_id))"""


@query(f"WITH {_F1} SELECT * FROM f")
def bio_f1_per_doc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bio_f1(_predicted(spark, sf))


@query(f"WITH {_F1} SELECT round(avg(f1), 6) AS avg_f1 FROM f")
def bio_f1_macro(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_f1(_predicted(spark, sf))


@query(f"""WITH {_PRED}, s AS (SELECT y_true AS tag, 1 AS g, 0 AS p, CAST(y_true = y_pred AS INT) AS hit FROM yy UNION ALL SELECT y_pred, 0, 1, CAST(y_true = y_pred AS INT) FROM yy), a AS (SELECT tag, sum(hit * g) AS tp, sum(g) AS sup, sum(p) AS pr FROM s WHERE tag <> 'O' GROUP BY 1)
SELECT tag, round(CASE WHEN pr > 0 THEN tp::DOUBLE / pr ELSE 0 END, 6) AS precision, round(CASE WHEN sup > 0 THEN tp::DOUBLE / sup ELSE 0 END, 6) AS recall, round(CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (pr + sup) ELSE 0 END, 6) AS f1, CAST(sup AS BIGINT) AS support FROM a""")
def bio_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.classification_report(_predicted(spark, sf))


@query(f"WITH {_PRED}, d AS (SELECT doc_id, min(CAST(y_true = y_pred AS INT)) AS a, sum(CAST(y_true = y_pred AS INT)) AS r, count(*) AS n FROM yy GROUP BY 1) SELECT round(avg(a), 6) AS sequence_accuracy, round(sum(r)::DOUBLE / sum(n), 6) AS token_accuracy FROM d")
def seq_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.sequence_accuracy(_predicted(spark, sf))


@query(f"""WITH {_PRED}, {_GRP.replace('coalesce(tag, ' + chr(39) + 'O' + chr(39) + ')', 'y_pred').replace('FROM bt)', 'FROM yy)')}, h AS (SELECT doc_id, group_no, bool_and(y_true = 'O') AS free FROM gn GROUP BY 1, 2)
SELECT doc_id, string_agg(CASE WHEN group_type <> 'O' AND free THEN y_pred ELSE y_true END, ' ' ORDER BY pos) AS tags FROM gn JOIN h USING (doc_id, group_no) GROUP BY 1""")
def merge_top_n(spark: SparkSession, sf: str) -> DataFrame:
    t = _predicted(spark, sf)
    both = t.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "y_true", "y_pred"))).alias("s"))
    chain = lambda r, c: F.struct(F.lit(r).alias("rank"), F.transform("s", lambda x: x[c]).alias("tags"))
    return chains.merge_top_n(both.select("doc_id", F.inline(F.array(chain(0, "y_true"), chain(1, "y_pred"))))).select("doc_id", F.array_join("tags", " ").alias("tags"))


# ----------------------------------------------------------------------------- domains

_HOST = r"lower(regexp_replace(regexp_extract({0}, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:\s]+)', 1), '\.+$', ''))"
_SUF = "[" + ", ".join(f"'{s}'" for s in domain.SUFFIXES) + "]"
_DOM = f"""CASE WHEN list_contains({_SUF}, array_to_string(l, '.')) THEN '' WHEN len(l) > 2 AND list_contains({_SUF}, array_to_string(l[len(l)-1:], '.')) THEN array_to_string(l[len(l)-2:], '.') WHEN len(l) > 1 AND NOT regexp_full_match(array_to_string(l, '.'), '[0-9.]+') THEN array_to_string(l[len(l)-1:], '.') ELSE '' END"""


@query(f"WITH h AS (SELECT page_id, string_split({_HOST.format('url')}, '.') AS l FROM pages WHERE url IS NOT NULL) SELECT page_id, {_DOM} AS domain FROM h")
def domain_registered(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", domain.registered_domain(F.col("url")).alias("domain"))


@query(f"WITH h AS (SELECT lang, string_split({_HOST.format('url')}, '.') AS l FROM documents), d AS (SELECT coalesce(lang, '?') AS doc_id, {_DOM} AS domain FROM h WHERE l IS NOT NULL), n AS (SELECT doc_id, domain, count(*) AS n FROM d WHERE domain <> '' GROUP BY 1, 2) SELECT doc_id, domain FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, domain) = 1")
def domain_mode(spark: SparkSession, sf: str) -> DataFrame:
    """The most frequent domain of the URLs of each language."""
    links = _docs(spark, sf).select(F.coalesce("lang", F.lit("?")).alias("lang"), "url")
    return domain.guess_domain(links, "lang", "url")


_BUILT = f"""WITH h AS (SELECT doc_id, doc_id % 5 AS k, string_split({_HOST.format('url')}, '.') AS l FROM documents WHERE url IS NOT NULL), d AS (SELECT doc_id, k, {_DOM} AS domain FROM h)"""


@query(_BUILT + " SELECT doc_id, CASE WHEN k IN (3, 4) THEN '' ELSE domain END AS domain FROM d")
def domain_built(spark: SparkSession, sf: str) -> DataFrame:
    """Pages built around a URL: a base element, a commented base in the head,
    most links among blacklisted ones; links to blacklisted sites only; none."""
    url, k = F.col("url"), F.col("doc_id") % 5
    black = F.concat(*[F.lit(f'<a href="http://www.{d}/x">x</a>') for d in domain.BLACKLIST * 2])
    head = F.when(k == 0, F.concat(F.lit('<base href="'), url, F.lit('">'))).when(k == 1, F.concat(F.lit('<!-- base href="'), url, F.lit('" -->'))).otherwise("")
    body = F.when(k == 2, F.concat(black, F.lit("<a href='"), url, F.lit("'>y</a>"))).when(k == 4, "<p>x</p>").otherwise(black)
    pages = table(spark, sf, "documents").where("url IS NOT NULL").select("doc_id", F.concat(F.lit("<html><head>"), head, F.lit("</head><body>"), body, F.lit("</body></html>")).alias("html"))
    return domain.page_domain(pages, "doc_id", "html")


@query(r"SELECT page_id, '' AS domain FROM pages")
def domain_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages link within their site only and have no base: nothing to go by."""
    return domain.page_domain(table(spark, sf, "pages"), "page_id", "html").withColumnRenamed("doc_id", "page_id")


# ----------------------------------------------------------------------------- splits


@query("WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, r > n - CAST(floor(n * 0.25) AS BIGINT) AS is_test FROM n")
def split_noshuffle(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_noshuffle(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query()
def group_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.group_folds(table(spark, sf, "pages").join(table(spark, sf, "sites").select("host"), "host", "left_semi"), "host", 4)


@query("WITH s AS (SELECT host FROM sites UNION ALL SELECT DISTINCT host FROM pages) SELECT host, count(*) AS n FROM s GROUP BY 1")
def corpus_union(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "sites").select("host"), table(spark, sf, "pages").select("host").distinct()
    return a.unionByName(b).groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT unnest(map_keys(map {'lang': lang, 'source': source, 'host': host})) AS key FROM documents ORDER BY 1")
def combined_keys(spark: SparkSession, sf: str) -> DataFrame:
    m = _docs(spark, sf).select(F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("host"), F.col("host")).alias("m"))
    return patterns.combined_keys(m, "m")


@query("SELECT doc_id, coalesce(lang, 'none') AS lang, source FROM documents")
def merge_maps(spark: SparkSession, sf: str) -> DataFrame:
    """The later map wins: the language of the second replaces the first's."""
    a = F.create_map(F.lit("lang"), F.lit("old"), F.lit("source"), F.col("source"))
    b = F.create_map(F.lit("lang"), F.coalesce("lang", F.lit("none")))
    m = _docs(spark, sf).select("doc_id", patterns.merge_maps(a, b).alias("m"))
    return m.select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["source"].alias("source"))
