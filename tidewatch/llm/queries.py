"""One registered query for each operator, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, context_tree, decontaminate, html_text, lexical_search, licenses, mixing, ngram_jaccard, prefix_trie, quality_rules, suffix_dedup, token_counts, toxicity
from tidewatch.llm.common import LOWER, UPPER, WORD, staged, table
from tidewatch.plans.registry import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


LOWER_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"


@query("op1_ngram_jaccard", f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS d, doc_id AS k FROM documents UNION SELECT l.u, r.k FROM r JOIN l ON l.v = r.d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.k AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(k) AS k FROM r GROUP BY d) m ON m.d = d.doc_id
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.link_components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*columns)


WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


@query("op2_suffix_dedup", """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS c FROM w) WHERE c > 1),
s AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS new FROM p),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM s),
n AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, g),
f AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM n),
k AS (SELECT d.r, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept,
      sum(b - a)::BIGINT AS removed, count(*) AS spans FROM f JOIN d ON d.r = f.r GROUP BY d.r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN k USING (r)
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(_documents(spark, sf_dir, "doc_id", "text"))


@query("op3_quality_rules", f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
tri AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
ln AS (SELECT r, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{WORD}')] AS l FROM w),
f AS (SELECT w.r, doc_id, CASE WHEN lang IN ('en', 'de', 'es', 'fr') THEN lang ELSE 'other' END AS s, len(w)::BIGINT AS n_words,
      coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN ln USING (r) LEFT JOIN cov USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
x AS (SELECT * FROM (VALUES ('n_symbols'), ('n_dup_lines'), ('n_repeat_words')) q(rule), (SELECT unnest([{', '.join(map(str, quality_rules.GRID))}]) AS cutoff)),
m AS (SELECT s, rule, cutoff, count_if(quality = 1) AS good,
      count_if(quality = 1 AND 1000 * CASE rule WHEN 'n_symbols' THEN n_symbols WHEN 'n_dup_lines' THEN n_dup_lines ELSE n_repeat_words END > n_words * cutoff) AS k,
      count_if(quality <> 1 AND 1000 * CASE rule WHEN 'n_symbols' THEN n_symbols WHEN 'n_dup_lines' THEN n_dup_lines ELSE n_repeat_words END > n_words * cutoff) AS b
      FROM g JOIN labels USING (doc_id) CROSS JOIN x WHERE quality IS NOT NULL AND NOT base_failed GROUP BY ALL),
c AS (SELECT s, rule, max({{'gain': b - k, 'cutoff': cutoff}}).cutoff AS cutoff FROM m
      WHERE k < good * 0.01 AND list_sum([exp(lgamma(good + 1) - lgamma(i + 1) - lgamma(good - i + 1) + i * ln(0.01) + (good - i) * ln(0.99)) FOR i IN range(0, (k + 1)::BIGINT)])
            <= {quality_rules.ERROR} / (5 * 3 * {len(quality_rules.GRID)}) GROUP BY s, rule),
v AS (SELECT g.r, bool_or(coalesce(1000 * CASE rule WHEN 'n_symbols' THEN n_symbols WHEN 'n_dup_lines' THEN n_dup_lines ELSE n_repeat_words END > n_words * cutoff, false)) AS bad
      FROM g LEFT JOIN c ON c.s = g.s GROUP BY g.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad) AS kept FROM g JOIN v USING (r)
""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_documents(spark, sf_dir, "doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


_WEIGHTS = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in mixing.WEIGHTS.items())


@query("op4_mix_sources", f"""
WITH w AS (SELECT * FROM (VALUES {_WEIGHTS}) t(g, share) UNION ALL SELECT '~rest', {1 - sum(mixing.WEIGHTS.values())!r}::DOUBLE),
d AS (SELECT *, CASE WHEN source IN ({', '.join(f"'{k}'" for k in mixing.WEIGHTS)}) THEN source ELSE '~rest' END AS g FROM documents),
z AS (SELECT g, sum(length(coalesce(text, '')))::DOUBLE AS size FROM d GROUP BY g),
r AS (SELECT g, CASE WHEN size > 0 THEN share * (SELECT sum(size) FROM z) / size ELSE 0 END AS rate FROM z JOIN w USING (g)),
p AS (SELECT g, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY g ORDER BY k) AS below
      FROM (SELECT g, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 41)::BIGINT)) AS k FROM r WHERE rate > 0)),
u AS (SELECT *, ('0x' || substr(md5(doc_id || ':{mixing.SEED}'), 1, 13))::BIGINT / {float(1 << 52)!r} AS u FROM d),
n AS (SELECT u.*, (SELECT count(*) FROM p WHERE p.g = u.g AND p.below <= u.u) AS n FROM u),
c AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       ('0x' || substr(md5(doc_id || ':' || copy || ':{mixing.SEED}'), 1, 15))::BIGINT AS shuffle_key FROM c
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op5_licenses")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir, "doc_id", "text"))


#: A conversation whose texts hold the template's marks.
_MARKS = "\\### Assistant: </turn> ok"


@query("op6_chat_windows", f"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '{_MARKS}' UNION ALL SELECT -7, 1, 'assistant', '{_MARKS}'),
o AS (SELECT *, row_number() OVER w AS i, len({WORDS}) + {chat.MARKS} AS tokens,
      {len(chat.HEAD) + len(chat.MIDDLE) + len(chat.END)} + length(regexp_replace(role, '([\\\\#<:])', '\\\\\\1', 'g')) + length(regexp_replace(text, '([\\\\#<])', '\\\\\\1', 'g')) AS size
      FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY i) - tokens AS before FROM o),
k AS (SELECT *, before // {chat.BUDGET} AS k FROM s),
e AS (SELECT *, max(before + tokens) OVER (PARTITION BY conv_id, k) AS stop, max(k) OVER (PARTITION BY conv_id) AS last FROM k),
n AS (SELECT conv_id, count(DISTINCT k) AS n, arg_min(size, i) FILTER (role = 'system') AS system FROM e GROUP BY conv_id),
t AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
      coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss,
      sum(size) + sum(CASE WHEN k < last AND stop - before <= {chat.HISTORY} THEN size ELSE 0 END) AS chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (chars + coalesce((n - 1) * system, 0))::BIGINT AS formatted_chars FROM t JOIN n USING (conv_id)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-7, 0, "user", _MARKS), (-7, 1, "assistant", _MARKS)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionAll(more)
    return chat.digests(staged(chat.windows(turns), "chat"))


def _fold(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


@query("op7_context_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _fold("doc_id", 7) == 2
    scored = context_tree.scores(_documents(spark, sf_dir, "doc_id", "text"), ~held)
    return scored.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS.split("|"))
_SLOTS = "(chr(1), '0', chr(2))"


@query("op8_decontaminate", rf"""
WITH m AS (SELECT 'd' AS k, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 'i', row_number() OVER (), item_id, text FROM benchmark),
a AS (SELECT k, r, id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''),
      '([\p{{Ll}}\p{{N}},;:] )(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), '[^\p{{L}}\p{{M}}\p{{N}}\x01]+', ' ', 'g'),
      '(\p{{N}})(\p{{L}})', '\1 \2', 'g'), '(\p{{L}})(\p{{N}})', '\1 \2', 'g') AS t FROM m),
b AS (SELECT k, r, id, trim(t) AS raw, [x FOR x IN string_split(lower(replace(t, chr(1), '')), ' ') IF x <> ''] AS e,
      [x FOR x IN string_split(lower(regexp_replace(regexp_replace(t, chr(1) || '[^ ]+', chr(1), 'g'), '\p{{N}}+', '0', 'g')), ' ') IF x <> ''] AS c FROM a),
u AS (SELECT k, r, id, raw, e, [CASE WHEN i > 1 AND c[i - 1] = '0' AND c[i] IN ({_UNITS}) THEN chr(2) ELSE c[i] END FOR i IN range(1, len(c) + 1)] AS c FROM b),
y AS (SELECT * FROM u WHERE k = 'i' AND len(c) > 0),
z AS (SELECT DISTINCT least(len(c), {decontaminate.WINDOW}) AS s FROM y),
-- an item's windows: templates, that of a first token taken for a name, and exact ones
v AS (SELECT r, id, least(len(c), {decontaminate.WINDOW}) AS s, c, e, unnest(range(1, len(c) - least(len(c), {decontaminate.WINDOW}) + 2)) AS pos FROM y),
w AS (SELECT r, id, s, pos, false AS exact, c[pos:pos + s - 1] AS q FROM v
      UNION ALL SELECT r, id, s, pos, false, list_concat([chr(1)], c[2:s]) FROM v WHERE pos = 1 AND r IN (SELECT r FROM y WHERE regexp_matches(raw, '^\p{{Lu}}'))),
x AS (SELECT r, id, s, pos, exact, 'T' || array_to_string(q, ' ') AS h FROM w WHERE 2 * len([o FOR o IN q IF o NOT IN {_SLOTS}]) >= s
      UNION ALL SELECT r, id, s, pos, true, 'E' || array_to_string(e[pos:pos + s - 1], ' ') FROM v),
n AS (SELECT r, count(DISTINCT pos) FILTER (WHERE NOT exact) AS n, count(DISTINCT pos) AS places FROM x GROUP BY r),
f AS MATERIALIZED (SELECT * FROM (
      SELECT r, s, unnest(range(1, len(c) - s + 2)) AS p, unnest(['T' || array_to_string(c[p:p + s - 1], ' ') FOR p IN range(1, len(c) - s + 2)]) AS h FROM u, z WHERE k = 'd' AND len(c) >= s
      UNION ALL SELECT r, s, unnest(range(1, len(c) - s + 2)), unnest(['E' || array_to_string(e[p:p + s - 1], ' ') FOR p IN range(1, len(c) - s + 2)]) FROM u, z WHERE k = 'd' AND len(c) >= s)
      WHERE (s, h) IN (SELECT s, h FROM x)),
-- aligned windows d: document row, item row i, places p and pos
l AS MATERIALIZED (SELECT f.r AS d, x.r AS i, f.p, x.pos, x.s, x.exact, f.p - x.pos AS diag, n.n, n.places FROM f JOIN x ON x.h = f.h AND x.s = f.s JOIN n ON n.r = x.r),
ca AS (SELECT d, i, any_value(n) AS n, any_value(places) AS places, count(DISTINCT pos) FILTER (WHERE NOT exact) AS a, count(DISTINCT pos) AS b FROM l GROUP BY d, i),
cv AS (SELECT d, i, CASE WHEN n > 0 AND a >= {decontaminate.SHARE} * n THEN a::DOUBLE / n ELSE b::DOUBLE / places END AS c FROM ca
       WHERE (n > 0 AND a >= {decontaminate.SHARE} * n) OR b >= {decontaminate.SHARE} * places),
-- occurrences: a diagonal, a run of near diagonals (a place for its best one only), or the whole text
k0 AS (SELECT d, i, diag, count(*) AS wt FROM l SEMI JOIN cv USING (d, i) GROUP BY d, i, diag),
k1 AS (SELECT *, CASE WHEN diag - lag(diag) OVER (PARTITION BY d, i ORDER BY diag) <= {decontaminate.WINDOW} THEN 0 ELSE 1 END AS new, count(*) OVER (PARTITION BY d, i) AS many FROM k0),
k2 AS (SELECT *, sum(new) OVER (PARTITION BY d, i ORDER BY diag) AS run FROM k1),
k3 AS (SELECT l.*, many, run, row_number() OVER (PARTITION BY l.d, l.i, run, p ORDER BY wt DESC, l.diag) AS nth, first_value(l.diag) OVER (PARTITION BY l.d, l.i, run, p ORDER BY wt DESC, l.diag) AS top
       FROM l JOIN k2 ON k2.d = l.d AND k2.i = l.i AND k2.diag = l.diag),
oc AS (SELECT *, 'diagonal' AS kind, diag AS place FROM k3 UNION ALL SELECT *, 'text', 0 FROM k3 WHERE many > 1 UNION ALL SELECT *, 'run', run FROM k3 WHERE many > 1 AND diag = top),
en AS (SELECT d, i, kind, place FROM oc GROUP BY d, i, kind, place
       HAVING (any_value(n) > 0 AND count(DISTINCT pos) FILTER (WHERE NOT exact) >= {decontaminate.SHARE} * any_value(n)) OR count(DISTINCT pos) >= {decontaminate.SHARE} * any_value(places)),
sl AS (SELECT DISTINCT o.d, o.i, o.kind, o.place, unnest(td.c[p:p + s - 1]) AS slot, unnest(ti.e[pos:pos + s - 1]) AS mine, unnest(td.e[p:p + s - 1]) AS theirs
       FROM oc o SEMI JOIN en ON en.d = o.d AND en.i = o.i AND en.kind = o.kind AND en.place = o.place JOIN u td ON td.k = 'd' AND td.r = o.d JOIN u ti ON ti.k = 'i' AND ti.r = o.i),
cl AS (SELECT d, i, kind, place FROM sl WHERE slot IN {_SLOTS} GROUP BY d, i, kind, place HAVING count(*) > count(DISTINCT (slot, mine)) OR count(*) > count(DISTINCT (slot, theirs))),
ok AS (SELECT DISTINCT d, i FROM en ANTI JOIN cl USING (d, i, kind, place)),
re AS (SELECT ok.d, count(DISTINCT y.id) AS n_items, min({{'c': -cv.c, 'item': y.id}}) AS best FROM ok JOIN cv USING (d, i) JOIN y ON y.r = ok.i GROUP BY ok.d)
SELECT u.id AS doc_id, re.d IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, best.item AS item, coalesce(-best.c, 0.0)::DOUBLE AS covered
FROM u LEFT JOIN re ON re.d = u.r WHERE u.k = 'd'
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op9_html_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir, "doc_id", "text")
    held = _fold("doc_id", 5) == 0
    model = toxicity.train(staged(toxicity.training_rows(docs, table(spark, sf_dir, "labels"), ~held), "toxicity-training"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_TERM}')"


@query("op11_lexical_search", f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_LOWER_TERMS} AS w FROM documents),
n AS (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM n),
i AS (SELECT row_number() OVER () AS i, item_id, {_LOWER_TERMS} AS w FROM benchmark),
q AS (SELECT DISTINCT i, item_id, unnest(w) AS t FROM i),
f AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY r, t),
g AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY t, docs),
m AS (SELECT r, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))) AS impact FROM f JOIN g USING (t) JOIN n USING (r), c),
s AS (SELECT i, item_id, r, sum(impact)::BIGINT AS score FROM q JOIN m USING (t) GROUP BY ALL HAVING sum(impact) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s JOIN n USING (r))
SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.token_counts(_documents(spark, sf_dir, "doc_id", "text"))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT)


@query("op13_prefix_trie", f"""
WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS tab
             FROM (SELECT unnest(range(0, 256)) AS i)),
a AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM a GROUP BY c),
h AS (SELECT c, xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: xor(a >> 8, list_extract(tab, (xor(a, b) & 255) + 1))), 4294967295) % {prefix_trie.GRAFT} AS h FROM n, tab),
m AS (SELECT h.c, h, h.c - h.c % {prefix_trie.FAMILY} AS base, least(h, coalesce(n.n, 0)) AS taken FROM h LEFT JOIN n ON n.c = h.c - h.c % {prefix_trie.FAMILY}),
t AS (SELECT m.c, a.i AS d, role, text FROM m JOIN a ON a.c = m.base AND a.i <= m.h
      UNION ALL SELECT m.c, a.i - m.h + m.taken, role, text FROM m JOIN a ON a.c = m.c AND a.i > m.h),
p AS (SELECT c, d, len({WORDS}) AS words, md5(string_agg(md5(role) || md5(text), '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k FROM t),
q AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY c ORDER BY d), '') AS up FROM p
      UNION ALL SELECT c, 0, 0, '', NULL FROM m),
g AS (SELECT d, k, up, min(c) AS c, count(*) AS n, any_value(words) AS words FROM q GROUP BY d, k, up),
e AS (SELECT d, k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d, max_by(k, d) AS k FROM q GROUP BY c) GROUP BY d, k),
s AS (SELECT g.d, g.k, count(u.k) AS n_children FROM g LEFT JOIN g u ON u.up = g.k AND u.d = g.d + 1 GROUP BY g.d, g.k),
f AS (SELECT x.d, x.k, count_if(s.n_children = 0) AS n_leaves, sum((g.n - 1) * g.words)::BIGINT AS saved
      FROM g JOIN s USING (d, k) JOIN q x ON x.c = g.c AND x.d <= g.d GROUP BY x.d, x.k)
SELECT g.c AS conv_id, g.d AS depth, o.c AS parent_conv_id, g.n AS n_convs, n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM g JOIN s USING (d, k) JOIN f USING (d, k) LEFT JOIN e USING (d, k) LEFT JOIN g o ON o.k = g.up AND o.d = g.d - 1
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, members = prefix_trie.graft(prefix_trie.numbered(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(staged(turns, "turns-rebuilt"), members).drop("p1", "p2")
