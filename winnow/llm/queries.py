"""The registered queries of the text operators, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damage, repair_report
from .decontaminate import decontaminate
from .line_dedup import line_dedup
from .ngram_lm import lm_score
from .packing import pack
from .quality import RULES, STOP_WORDS, quality
from .search import ranked_search
from .secret_scan import find_secrets, joined
from .sharding import shard
from .simhash import simhash_groups
from .substring_dedup import substring_dedup
from .toxicity import held_out, toxicity, train
from .url_filter import RULES as URL_RULES
from .url_filter import SYMBOLS, Markov, url_verdicts

#: Bytes of text of a shard.
SHARD_BYTES = 1 << 20


def tokenizer_path() -> str:
    """The tokenizer file that the packing query names; any other can be passed to ``pack``."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    counts = [F.array_size(F.array_remove(F.transform("found", lambda x: F.when(x["kind"] == F.lit(k), 1).otherwise(0)), 0)).cast("long").alias(name) for k, name in enumerate(("n_assign", "n_access", "n_hex"))]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("found"), most=3), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(_table(spark, sf_dir, "conversations")), copies_col="copies")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_toxicity, op4_secret_scan, op5_line_dedup, op6_sharding, op7_lm_scoring, op8_decontamination, op9_packing, op10_simhash, op11_ranked_search, op12_url_filter, op13_conversation_repair)
}

_WORDS = r"coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), [])"

_OP1 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
r AS (SELECT s FROM h GROUP BY s HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM h JOIN r USING (s)),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM x ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


def _condition(rule) -> str:
    value = f"CAST({rule.part} AS DOUBLE)" if rule.whole is None else f"({rule.part} * 100.0 / nullif({rule.whole}, 0))"
    tests = [f"{value} >= {rule.low}"] if rule.low is not None else []
    tests += [f"{value} <= {rule.high}"] if rule.high is not None else []
    return " AND ".join(f"coalesce({t}, true)" for t in tests)


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(STOP_WORDS))

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
q AS (SELECT r, s FROM g GROUP BY r, s HAVING count(*) > 1),
p AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM g JOIN q USING (r, s)) GROUP BY r),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
  len(l) AS n_text_lines, len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
  len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop_words, len(list_filter(w, lambda x: ends_with(x, '!!'))) AS n_exclaimed, len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
  FROM d LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(f"({_condition(r)})" for r in RULES)} AS kept FROM b
"""

_OP5 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS p FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM x),
s AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
e AS (SELECT k.*, owner IS NOT NULL AND owner <> doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM e GROUP BY doc_id
"""

_OP11 = r"""
WITH terms AS (SELECT 0 AS kind, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
t AS (SELECT kind, r, id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM terms),
p AS (SELECT r, id, term, count(*) AS tf FROM t WHERE kind = 0 GROUP BY r, id, term),
d AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS all_terms FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT id, term FROM t WHERE kind = 1),
w AS (SELECT q.id AS item_id, term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN f USING (term), g),
s AS (SELECT item_id, r, any_value(p.id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // all_terms))))) AS BIGINT) AS score
  FROM w JOIN p USING (term) JOIN d USING (r), g GROUP BY item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""



def _op12(m: Markov) -> str:
    def low(x: str) -> str:
        return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def ruled(value: str) -> str:
        fits = "\n".join(f"WHEN (host = '{x.host}' OR ends_with(host, '.{x.host}')) AND starts_with(path, '{x.path}') THEN '{getattr(x, value)}'" for x in sorted(URL_RULES, key=lambda x: -len(x.name)))
        return f"CASE {fits} END"

    symbols = SYMBOLS.replace("'", "''")
    levels, beta = [], m.strength
    for d in range(m.order + 1):
        was = [f"was.p_{k}" if d else f"(1.0::DOUBLE / {len(SYMBOLS)})" for k in "ar"]
        grown = ", ".join(f"(coalesce(g.{k}, 0) + {beta}::DOUBLE * {w}) / (n_{k} + {beta}::DOUBLE) AS p_{k}" for k, w in zip("ar", was, strict=True))
        joined = f"JOIN p{d - 1} was ON was.ctx = substr(o.ctx, 2) AND was.c = y.c" if d else ""
        levels.append(f"p{d} AS MATERIALIZED (SELECT o.ctx, y.c, {grown} FROM (SELECT * FROM own WHERE length(ctx) = {d}) o, sym y LEFT JOIN g ON g.ctx = o.ctx AND g.c = y.c {joined})")
    cells = " UNION ALL ".join(f"SELECT ctx, c, CAST(round(1e6 * (ln(p_a) - ln(p_r))) AS BIGINT) AS diff FROM p{d}" for d in range(m.order + 1))
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT r, page_id, coalesce({low(r"regexp_extract(rest, '^[^/?#]*')")}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
  '^' || regexp_replace({low("coalesce(rest, url, '')")}, '[^a-z0-9\-._~/?#=&%+:;,@!$''()\[\]]', '*', 'g') || '|' AS s FROM u),
d AS (SELECT *, {ruled("name")} AS rule, {ruled("verdict")} AS said FROM h),
i AS (SELECT r, said, s, unnest(range(2, length(s) + 1)) AS i FROM d),
x AS MATERIALIZED (SELECT r, said, i, k, substr(s, i, 1) AS c, substr(s, i - k, k) AS ctx FROM (SELECT *, unnest(range(0, least({m.order + 1}, i))) AS k FROM i)),
g AS MATERIALIZED (SELECT ctx, c, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS r FROM x WHERE said IS NOT NULL GROUP BY ctx, c),
n AS (SELECT CAST(sum(length(s) - 1) AS BIGINT) AS total, count(*) FILTER (said = 'allow') AS good, count(*) FILTER (said = 'block') AS bad FROM d WHERE said IS NOT NULL),
own AS MATERIALIZED (SELECT ctx, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(r) AS BIGINT) AS n_r FROM g GROUP BY ctx HAVING sum(a + r) * {m.share} >= (SELECT total FROM n)),
sym AS (SELECT unnest(string_split('{symbols}', '')) AS c),
{", ".join(levels)},
cells AS ({cells}),
one AS (SELECT r, i, arg_max(diff, k) AS diff FROM x JOIN cells USING (ctx, c) GROUP BY r, i),
score AS (SELECT r, CAST(floor(CAST(sum(diff) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM one GROUP BY r),
bins AS (SELECT CAST(floor(score / 10000.0) AS BIGINT) AS bin, count(*) FILTER (said = 'allow') AS a, count(*) FILTER (said = 'block') AS b FROM d JOIN score USING (r) WHERE said IS NOT NULL GROUP BY bin),
gain AS (SELECT bin, sum(a * bad - b * good) OVER (ORDER BY bin DESC) AS gain FROM bins, n),
least AS (SELECT bin * 10000 AS least FROM gain ORDER BY gain DESC, bin LIMIT 1)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= (SELECT least FROM least) OR (SELECT good = 0 OR bad = 0 FROM n) THEN 'allow' ELSE 'block' END) AS verdict FROM d LEFT JOIN score USING (r)
"""




def _op13() -> str:
    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def edit(state: str, cost: str, letter: str, line: str, when: str = "true") -> str:
        return f"CASE WHEN {when} THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'o': {state}.o || {line}}} ELSE {far} END"

    far = "{'c': 1000000000::BIGINT, 'a': '', 'o': ''}"
    user, assistant, own = "chr(10) || 'user:'", "chr(10) || 'assistant:'", "chr(10) || role || ':' || text"
    # what insertions reach: u after nothing, after a system or an assistant row; then a
    w2 = best("v2", *(edit(f"v{s}", "2", "I", user) for s in (0, 1, 3)))
    closed = f"SELECT *, {w2} AS w2, v0 AS w0, v1 AS w1, {best('v3', edit(w2, '2', 'I', assistant))} AS w3"
    # the second u may follow the a that this reaches
    stay, delete = "NOT must", {s: edit(f"w{s}", "3", "D", "''") for s in range(4)}
    as_user = [edit(f"w{s}", "t", "K", own, f"{stay} AND i = 'u'") for s in (0, 1, 3)] + [edit(f"w{s}", "2 + t", "R", user + " || text", stay) for s in (0, 1, 3)]
    v = [
        delete[0],
        best(delete[1], edit("w0", "t", "K", own, f"{stay} AND i = 's'")),
        best(delete[2], *as_user),
        best(delete[3], edit("w2", "t", "K", own, f"{stay} AND i = 'a'"), edit("w2", "2 + t", "R", assistant + " || text", stay)),
    ]
    bits = "[ascii(x), -1, -1, -1, -1, -1, -1, -1, -1]"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda x: {bits}::BIGINT[]))), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295)"
    start = f"{{'c': 0::BIGINT, 'a': '', 'o': ''}} AS v0, {', '.join(f'{far} AS v{s}' for s in (1, 2, 3))}"
    return rf"""
WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
d AS (SELECT conv_id, turn, role, text, {crc} % 20 AS k FROM s),
e AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 0 THEN 0 WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM e),
f AS (SELECT *, solid = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, CASE WHEN right(solid, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS t, substr(role, 1, 1) AS i FROM o),
r AS MATERIALIZED (SELECT *, blank OR again AS must, lag(i) OVER (PARTITION BY conv_id ORDER BY p) AS was FROM f),
x AS (SELECT conv_id, 0::BIGINT AS p, {start} FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT conv_id, p, {", ".join(f"{y} AS v{n}" for n, y in enumerate(v))} FROM (
    SELECT c.conv_id, r.p, r.role, r.text, r.must, r.t, r.i, w0, w1, w3, {best("w2", edit("w3", "2", "I", user))} AS w2
    FROM ({closed} FROM x) c JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.p = c.p + 1)),
z AS (SELECT conv_id, {best("w0", "w3")} AS y FROM ({closed} FROM x QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY p DESC) = 1)),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT must AND t = 1) AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || i NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(y.c, 0) AS BIGINT) AS cost, coalesce(y.a, '') AS audit, sha256(coalesce(substr(y.o, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""


#: Ordered by operator; the others are tested against brute-force versions in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": _OP1, "op2_quality_rules": _OP2, "op5_line_dedup": _OP5, "op11_ranked_search": _OP11, "op12_url_filter": _op12(Markov()), "op13_conversation_repair": _op13()}
