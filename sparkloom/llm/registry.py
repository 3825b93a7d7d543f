"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import ann, bpe, chat, decontam, divergence, langid, mixing, quality, secrets, simhash, toxicity, urls, variants
from sparkloom.llm.common import held_out, read

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.Ledger(read(spark, sf_dir, "documents")).apply()
    base = sum(quality.BIT[r] for r in quality.BASE)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "n_lines", "n_bullet_lines", "n_ellipsis_lines", "fail_bits", "policy"
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.Ledger(read(spark, sf_dir, "documents")).ablations()


def quality_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.Ledger(read(spark, sf_dir, "documents")).compare()


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.decode(bpe.encode(read(spark, sf_dir, "documents"), RANKS, PATTERN), RANKS, PATTERN)
    return ids.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"), RANKS, PATTERN)
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("spans"), k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(secrets.joined(base).cast("binary"), 256).alias("base_sha256"),
        secrets.joined(F.col("spans")).alias("spans"),
        secrets.count_of(F.col("spans"), "random").alias("n_random"),
    )


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.cluster(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: The labels know one category.  Two finer ones are silver labels: toxic documents that
#: hold one of a few plain English terms (fixed values, nouns and adjectives).
CATEGORIES = {
    "silver_insult": "toxic = 1 AND arrays_overlap(words, array('idiot', 'moron', 'loser', 'clown', 'scum', 'trash'))",
    "silver_demeaning": "toxic = 1 AND arrays_overlap(words, array('stupid', 'worthless', 'pathetic', 'disgusting'))",
    "toxic": "toxic = 1",
}


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    chain = toxicity.learn(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"), CATEGORIES)
    return toxicity.predict(docs, chain).withColumnRenamed("flagged", "toxic")


#: Conversation -7: control strings of a common template inside both texts.
PROBE = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.expand(turns.unionByName(probe)), clustered=True)


#: Dated list entries, as fixed examples: (list, domain, day, action).
LIST_ENTRIES = [
    (name, f"{stem}.example.{tld}", day, action)
    for name, stem, events in (
        ("spam", "cheap-pills", (("2023-11-01", "add"), ("2024-03-01", "remove"), ("2024-05-15", "add"))),
        ("spam", "spam-farm", (("2024-02-10", "add"),)),
        ("ads", "ads-track", (("2024-01-20", "add"), ("2024-07-01", "remove"), ("2024-07-01", "add"), ("2024-10-01", "remove"))),
        ("gambling", "casino-win", (("2023-06-01", "add"), ("2024-06-30", "remove"))),
        ("gambling", "free-bets", (("2024-04-01", "add"), ("2024-08-01", "add"))),
        ("adult", "adult-x", (("2022-01-01", "add"),)),
        ("spam", "tionsh", (("2024-03-05", "add"), ("2024-03-12", "remove"))),
        ("spam", "blog.tionsh", (("2024-09-01", "add"),)),
    )
    for tld in ("com", "net", "org")
    for day, action in events
]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time: page_id modulo 366 counts days from the first of 2024."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.expr("date_add(DATE'2024-01-01', cast(pmod(coalesce(page_id, 0), 366) as int))").alias("fetched_on"))
    entries = spark.createDataFrame(LIST_ENTRIES, "list string, domain string, day string, action string").withColumn("day", F.to_date("day"))
    return urls.evaluate(pages, entries).select("page_id", "url", "fetched_on", "host", "blocked", "list", "domain", "valid_from")


LEVELS = ["domain", "language", "source"]
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "language": {"en": 5, "de": 2, "fr": 2, "es": 1}}
SHARE, EPOCHS, SEED = (3, 5), 2, 17


def leaf_columns(docs: DataFrame, lang_col: str = "lang", source_col: str = "source") -> list:
    """Levels of the tree: sources are dealt to four domains by their number."""
    number = F.coalesce(F.expr(f"try_cast(regexp_extract({source_col}, '([0-9]{{1,9}})$', 1) as int)"), F.lit(0))
    return [F.concat(F.lit("d"), (number % 4).cast("string")).alias("domain"), F.coalesce(docs[lang_col], F.lit("unknown")).alias("language"), F.coalesce(docs[source_col], F.lit("unknown")).alias("source")]


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = mixing.Scratch(spark, "mix").write(docs.select("doc_id", *leaf_columns(docs), mixing.words(docs["text"]).alias("tokens")))
    return mixing.mix(rows, LEVELS, WEIGHTS, SHARE, EPOCHS, SEED).select("doc_id", *LEVELS, "tokens", "alloc", "copies")


def op9_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    asked = rows.where("pmod(vec_id, 20) = 0").select(F.col("vec_id").cast("long").alias("query_id")).distinct()
    return ann.Index(rows).search(asked)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~held_out(docs["doc_id"]) & docs["doc_id"].isNotNull()))
    return langid.predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(read(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


#: Measurements of op1, with SQL's own windows and joins in place of a pass in Python.
_MEASURES_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, list_extract(ws, i) || ' ' || list_extract(ws, i + 1) || ' ' || list_extract(ws, i + 2) AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM g) WHERE c > 1),
c AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM r) GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]')))::BIGINT AS n_bullet_lines,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$')))::BIGINT AS n_ellipsis_lines
  FROM w LEFT JOIN c USING (rid)),
b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (word_chars < 2 * n_words)::BIGINT + 16 * (word_chars > 15 * n_words)::BIGINT
    + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 64 * (10 * n_bullet_lines > 9 * n_lines)::BIGINT + 128 * (10 * n_ellipsis_lines > 3 * n_lines)::BIGINT)::BIGINT AS fail_bits FROM m)
"""

_MASK = quality.mask(quality.PRODUCTION)
OP1_SQL = f"""WITH {_MEASURES_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, (fail_bits & {_MASK}) = 0 AS kept, n_lines, n_bullet_lines, n_ellipsis_lines, fail_bits, '{quality.PRODUCTION}' AS policy FROM b"""

_RULE_ROWS = ", ".join(f"('{name}', {quality.BIT[name]}::BIGINT)" for name in quality.POLICIES[quality.PRODUCTION])
ABLATIONS_SQL = f"""WITH {_MEASURES_SQL}
SELECT rule, count(*) FILTER (WHERE fail_bits & bit <> 0)::BIGINT AS n_failed, count(*) FILTER (WHERE fail_bits & {_MASK} = bit)::BIGINT AS n_only, count(*) FILTER (WHERE fail_bits & {_MASK} & ~bit = 0)::BIGINT AS n_kept_without
FROM b, (VALUES {_RULE_ROWS}) AS rules(rule, bit) GROUP BY rule"""

_POLICY_ROWS = ", ".join(f"('{p}', {quality.mask(p)}::BIGINT)" for p in quality.POLICIES)
POLICIES_SQL = f"""WITH {_MEASURES_SQL}
SELECT policy, count(*)::BIGINT AS n_docs, count(*) FILTER (WHERE fail_bits & mask = 0)::BIGINT AS n_kept FROM b, (VALUES {_POLICY_ROWS}) AS p(policy, mask) GROUP BY policy"""


OP5_SQL = r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
r AS (SELECT *, length('<|' || role || '|>' || chr(10)) + length(regexp_replace(regexp_replace(regexp_replace(text, '([\\|])', '\\\1', 'g'), '<(/?s>)', '<\\\1', 'g'), '[[](/?INST[]])', '[\\\1', 'g')) + length('<|end|>' || chr(10)) AS n,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS turns FROM t),
c AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, role = 'assistant' AS reply FROM r)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE reply), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE reply), '')) AS loss_sha256,
  sum(upto) FILTER (WHERE reply OR k = turns)::BIGINT AS formatted_chars, count(*) FILTER (WHERE reply OR k = turns)::BIGINT AS n_examples
FROM c GROUP BY conv_id"""

_ENTRY_ROWS = ", ".join(f"('{a}', '{b}', DATE '{c}', '{d}')" for a, b, c, d in LIST_ENTRIES)
OP6_SQL = rf"""WITH e(list, domain, day, action) AS (VALUES {_ENTRY_ROWS}),
daily AS (SELECT list, domain, day, bool_or(action = 'add') AS is_on FROM e GROUP BY ALL),
iv AS (SELECT * FROM (SELECT list, domain, is_on, day AS valid_from, coalesce(lead(day) OVER (PARTITION BY list, domain ORDER BY day), DATE '9999-12-31') AS valid_to FROM daily) WHERE is_on),
p AS (SELECT row_number() OVER () AS rid, page_id, url, (DATE '2024-01-01' + ((coalesce(page_id, 0) % 366 + 366) % 366)::INT)::DATE AS fetched_on, coalesce(rtrim(regexp_extract(lower(url), '{urls.HOST}', 1), '.'), '') AS host FROM pages),
hits AS (SELECT rid, list, domain, valid_from, row_number() OVER (PARTITION BY rid ORDER BY length(domain) DESC, list, valid_from) AS k
  FROM p JOIN iv ON (host = domain OR ends_with(host, '.' || domain)) AND fetched_on >= valid_from AND fetched_on < valid_to)
SELECT page_id, url, fetched_on, host, list IS NOT NULL AS blocked, list, domain, valid_from FROM p LEFT JOIN (SELECT * FROM hits WHERE k = 1) USING (rid)"""


def _mix_sql() -> str:
    def weight(level: str) -> str:
        known = WEIGHTS.get(level, {})
        return "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in known.items()) + " ELSE 1 END" if known else "1"

    def deal(k: int) -> str:
        """Budgets of level k: saturated children get their capacity, the rest share by weight."""
        up, keys = ", ".join(["root", *LEVELS[:k]]), ", ".join(["root", *LEVELS[: k + 1]])
        child = LEVELS[k]
        budget = f"least(floor(sum(tokens) OVER (PARTITION BY root) * {SHARE[0]} / {SHARE[1]})::HUGEINT, sum(cap) OVER (PARTITION BY root))" if not k else f"(SELECT alloc FROM b{k - 1} u WHERE {' AND '.join(f'u.{x} = n.{x}' for x in LEVELS[:k])})"
        return f"""n{k} AS (SELECT {keys}, sum(cap) AS cap, sum(tokens) AS tokens, {weight(child)}::HUGEINT AS w FROM leaf GROUP BY {keys}),
g{k} AS (SELECT *, {budget} AS budget FROM n{k} n),
o{k} AS (SELECT *, cap * sum(w) OVER (z ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= w * (budget - coalesce(sum(cap) OVER (z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM g{k} WINDOW z AS (PARTITION BY {up} ORDER BY cap::DOUBLE / w, {child})),
l{k} AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {up}) AS remains, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {up}) AS open_w FROM o{k}),
p{k} AS (SELECT *, CASE WHEN is_full THEN cap ELSE (w * remains) // greatest(open_w, 1) END AS part FROM l{k}),
b{k} AS (SELECT *, part + CASE WHEN NOT is_full AND sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER (PARTITION BY {up} ORDER BY {child} ROWS UNBOUNDED PRECEDING) <= remains - sum(CASE WHEN is_full THEN 0 ELSE part END) OVER (PARTITION BY {up}) THEN 1 ELSE 0 END AS alloc FROM p{k})"""

    return rf"""WITH d AS (SELECT 0 AS root, doc_id, 'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents),
leaf AS (SELECT root, domain, language, source, sum(tokens) AS tokens, sum(tokens) * {EPOCHS} AS cap FROM d GROUP BY ALL),
{deal(0)},
{deal(1)},
{deal(2)},
s AS (SELECT d.*, alloc, (alloc // greatest(b2.tokens, 1))::BIGINT AS whole, alloc - (alloc // greatest(b2.tokens, 1)) * b2.tokens AS rest FROM d JOIN b2 USING (domain, language, source)),
h AS (SELECT *, md5('{SEED}|' || whole || '|' || coalesce(doc_id::VARCHAR, '')) AS place FROM s),
r AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, source ORDER BY place, doc_id, tokens ROWS UNBOUNDED PRECEDING) AS upto FROM h)
SELECT doc_id, domain, language, source, tokens, alloc::BIGINT AS alloc, (CASE WHEN tokens <= 0 THEN 0 ELSE whole + (upto <= rest)::BIGINT END)::BIGINT AS copies FROM r"""


OP8_SQL = _mix_sql()


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP11_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
t AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {divergence.LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY ALL),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + ({divergence.ONE}::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.total, 0) + 2 * v.v) AS p, 1 + ({divergence.ONE}::HUGEINT * (k.n + 2)) // (v.total + 2 * v.v) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source LEFT JOIN x y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
one AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM x WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM one)
SELECT lang, source, part, item, value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {divergence.TOP}"""

OP13_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, n, array_to_string(ws[k + 1:k + n], ' ') AS g FROM (SELECT item, ws, least({decontam.WINDOW}, len(ws)) AS n, unnest(range(len(ws) - least({decontam.WINDOW}, len(ws)) + 1)) AS k FROM b WHERE len(ws) > 0)),
p AS (SELECT rid, n, k, array_to_string(ws[k + 1:k + n], ' ') AS g FROM (SELECT rid, ws, n, unnest(range(len(ws) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
h AS (SELECT DISTINCT rid, k, n, item FROM p JOIN w USING (n, g)),
hit AS (SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS spot FROM h) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "quality_ablations": quality_ablations,
        "quality_policies": quality_policies,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_toxicity": op3_toxicity,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_chat_formatting": op5_chat_formatting,
        "op6_url_filters": op6_url_filters,
        "op7_secret_scans": op7_secret_scans,
        "op8_mixing": op8_mixing,
        "op9_ann_search": op9_ann_search,
        "op10_language_id": op10_language_id,
        "op11_source_divergence": op11_source_divergence,
        "op12_spelling_variants": op12_spelling_variants,
        "op13_decontamination": op13_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "quality_ablations": ABLATIONS_SQL, "quality_policies": POLICIES_SQL, "op5_chat_formatting": OP5_SQL, "op6_url_filters": OP6_SQL, "op8_mixing": OP8_SQL, "op11_source_divergence": OP11_SQL, "op13_decontamination": OP13_SQL}
