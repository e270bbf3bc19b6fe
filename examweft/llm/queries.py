"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from examweft.llm import bpe, chat, dedup, jaccard, licenses, media, merkle, minhash, packing, pii, quality, spelling, urls
from examweft.llm.common import read, prepare


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.encode(read(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.token_pieces(docs, bpe_path()))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT conv_id, turn, role, text FROM VALUES (-1L, 0L, 'user', '{both}'), (-1L, 1L, 'assistant', '{both}') AS t(conv_id, turn, role, text)")
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_conversations(turns.unionByName(extra)))


OP4_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), w AS (
  SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
    length(role) + length(text)
      + length(regexp_replace(role || text, '[^\\\\<\\[]', '', 'g'))
      + length(regexp_replace(role, '[^|]', '', 'g')) + 5 AS chars
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) + 7 AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), bpe_path())
    decoded = bpe.decode(encoded, bpe_path(), keep=("doc_id", "n_tokens"))
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH u AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), p AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN path LIKE '/%' AND regexp_matches(host, '(^|[.-])(bet|bets|casino|pills|poker|porn|xxx)[.-]') THEN 'block'
    WHEN regexp_matches(path, '^/(ads|cart|checkout|login|logout|signup|track|wp-login[.]php)([\x00-\x24\x26-\x2C/\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]|$)') THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.groups(read(spark, sf_dir, "documents").select("doc_id", "text"), keep="max")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.classify(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("found")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    lower = F.translate("text", merkle.UPPER, merkle.LOWER)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    tampered = F.when(hit, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), lower))
    found = merkle.manifest(docs, tampered=tampered).withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("steps")))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Unsigned CRC-32 of a text's UTF-8 bytes, a bit at a time: for hexadecimal digits of the bytes in a column.
_CRC32 = """(4294967295 - list_reduce(
  list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, CAST(length({hex}) AS BIGINT), 2), lambda i: CAST(('0x' || substr({hex}, i, 2)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda r, k: xor(r >> 1, CASE WHEN r % 2 = 1 THEN 3988292384 ELSE 0 END))))"""


def _merkle_sql(levels: int = 8) -> str:
    """The tree level by level, as many as 8 ** levels leaves of a group need; the groups' ends count as one run of eight at most."""
    field = lambda c, v="": f"coalesce(strlen(CAST({v or c} AS VARCHAR)) || ':' || CAST({v or c} AS VARCHAR), '-')"
    fields = " || ".join(map(field, ("doc_id", "source", "lang", "n_chars")))
    lower = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    parts = [f"""WITH d AS (
  SELECT *, {_CRC32.format(hex="hex(encode(CAST(doc_id AS VARCHAR)))")} % 3 = 0 AS hit FROM documents
), l0 AS (
  SELECT doc_id, lang, sha256({fields} || {field("text")}) AS leaf, sha256({fields} || CASE WHEN hit THEN {field("text", lower)} ELSE {field("text")} END) AS start
  FROM d
), n0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS p0, count(*) OVER (PARTITION BY lang) AS c0, leaf AS h0 FROM l0
)"""]
    for k in range(levels):
        up = f"p{k} // 8"
        parts.append(f"""r{k} AS (
  SELECT DISTINCT lang, p{k} AS p, h{k} AS h, c{k} AS c FROM n{k} WHERE c{k} > 1
), u{k} AS (
  SELECT lang, p // 8 AS up, sha256(string_agg(h, '' ORDER BY p)) AS parent, list(h ORDER BY p) AS run FROM r{k} GROUP BY lang, p // 8
), n{k + 1} AS (
  SELECT n.*, CASE WHEN c{k} > 1 THEN {up} ELSE 0 END AS p{k + 1}, (c{k} + 7) // 8 AS c{k + 1}, coalesce(parent, h{k}) AS h{k + 1},
    coalesce(array_to_string(run[:p{k} % 8], ''), '') AS a{k}, coalesce(array_to_string(run[p{k} % 8 + 2:], ''), '') AS b{k}, run IS NOT NULL AS s{k}
  FROM n{k} n LEFT JOIN u{k} u ON n.lang IS NOT DISTINCT FROM u.lang AND u.up = {up}
)""")
    top = f"h{levels}"
    parts.append(f"""g AS (SELECT DISTINCT lang, {top} AS subroot FROM n{levels}
), t AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS q FROM g
), e AS (SELECT CASE WHEN count(*) > 1 THEN sha256(string_agg(subroot, '' ORDER BY q)) ELSE min(subroot) END AS root, list(subroot ORDER BY q) AS run FROM t
), z AS (
  SELECT n.*, t.subroot, e.root, array_to_string(e.run[:q], '') AS a{levels}, array_to_string(e.run[q + 2:], '') AS b{levels}, len(e.run) > 1 AS s{levels}
  FROM n{levels} n JOIN t ON n.lang IS NOT DISTINCT FROM t.lang CROSS JOIN e
), f0 AS (SELECT *, start AS f FROM z)""")
    parts += [f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN s{k} THEN sha256(a{k} || f || b{k}) ELSE f END AS f) FROM f{k})" for k in range(levels + 1)]
    siblings = " || ".join(f"a{k} || b{k}" for k in range(levels + 1))
    return ", ".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, sha256({siblings}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{levels + 1}"


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(read(spark, sf_dir, "documents").select("doc_id", "text"), cut_every=97)
    return spelling.variants(words)


OP12_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents
), c AS (
  SELECT doc_id, translate(run, '{merkle.UPPER}', '{merkle.LOWER}') AS run, count(*) AS n FROM r GROUP BY ALL
), h AS (
  SELECT *, {_CRC32.format(hex="hex(encode(CAST(doc_id AS VARCHAR) || ':' || run))")} AS h FROM c
), v AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), w AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), d AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS p)
), e AS (
  SELECT a.word, b.word AS other, b.n AS m FROM d a JOIN d b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word
  UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word
), f AS (
  SELECT word, count(*) AS n_near, min({{'less': -m, 'word': other}}) AS best FROM e GROUP BY word
), g AS (
  SELECT word, CASE WHEN -best.less >= 2 * n THEN best.word END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n
  FROM w LEFT JOIN f USING (word)
), t AS (
  SELECT word, form AS last FROM g WHERE form IS NOT NULL
  UNION ALL SELECT t.word, g.form FROM t JOIN g ON g.word = t.last WHERE g.form IS NOT NULL
), ends AS (
  SELECT t.word, last AS root FROM t JOIN g ON g.word = t.last WHERE g.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM g LEFT JOIN ends USING (word)
"""


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""

_QUERIES = {f.__name__: f for f in (
    op1_matroska, op2_packing, op3_jaccard, op4_chat, op5_licenses, op6_bpe, op7_urls, op8_exact_dedup, op9_quality, op10_pii,
    op11_merkle, op12_spelling, op13_minhash,
)}
_SQL = {"op4_chat": OP4_SQL, "op7_urls": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_merkle": _merkle_sql(), "op12_spelling": OP12_SQL}


def queries() -> dict:
    def ready(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return query

    return {name: ready(f) for name, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
