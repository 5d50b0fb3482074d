"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausemill.llm.chat import format_chats, read_loss, read_turns
from clausemill.llm.chunk_dedup import exact_dedup
from clausemill.llm.collocations import collocations
from clausemill.llm.common import read
from clausemill.llm.decontaminate import contamination
from clausemill.llm.html_text import page_texts
from clausemill.llm.lexical import ranked
from clausemill.llm.mixing import mix, taken
from clausemill.llm.quality import quality
from clausemill.llm.simhash import near_duplicates
from clausemill.llm.substrings import remove_repeats
from clausemill.llm.token_shards import Vocabulary, write_shards
from clausemill.llm.toxicity import toxicity, train
from clausemill.llm.warc import read_chunks, records, write_warc


def op1_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Writes all documents as shards and returns the index of their sequences."""
    return write_shards(read(spark, folder, "documents"), Vocabulary.public()).index


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return toxicity(docs, train(docs, read(spark, folder, "labels")))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts are full of control strings, read back from what was formatted."""
    said = "</s>[INST] ok [/INST]"
    hard = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    told = format_chats(rows).withColumn("_turns", read_turns(F.col("formatted")))
    lines = F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return told.withColumn("_loss", read_loss(F.col("segments"))).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


#: The template's strings stand here in full, apart from the code that builds them.
OP3_SQL = r"""
WITH told AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         length(regexp_replace(text,
           '([\[<])(~*(?:SYS\]|/SYS\]|INST\]|/INST\]|s>|/s>|ROLE\]|:\]|/ROLE\]))', '\1~\2', 'g'))
         + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                ELSE 16 + length(coalesce(role, '')) END AS chars
  FROM told)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(coalesce(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                              WHEN before IN ('system', 'assistant') THEN role = 'user'
                              ELSE before = 'user' AND role = 'assistant' END, false)) AS valid
FROM marked GROUP BY conv_id
"""


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"))


def op6_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(read(spark, folder, "documents")).drop("removed")


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(read(spark, folder, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


OP8_SQL = r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER w AS r, first_value(doc_id) OVER w AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM norm WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST
                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM ranked
"""

def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(read(spark, folder, "pages"))


def op10_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return taken(mix(read(spark, folder, "documents"))).select("doc.doc_id", "size", "source_size", "target", "taken")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read(spark, folder, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
spoken AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM spoken),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM places, range(1, 5) AS ks(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
asked AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
cuts AS (SELECT lang, phrase, a, unnest(range(1, k)) AS cut, w, k FROM asked),
scored AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * c.a) // (x.f + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:cut], ' ')
              JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[cut + 1:c.k], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM asked, range(2, 4) AS ms(m), range(1, 4) AS places(i) WHERE m < k AND i + m - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN inside USING (lang, phrase) JOIN total USING (lang)
WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


def op12_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Writes all pages as WARC archives and returns what is read back from them."""
    told = records(read_chunks(spark, write_warc(read(spark, folder, "pages"))))
    return told.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP12_SQL = """
WITH told AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) END AS seen
         FROM told)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN seen > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN seen > page_id THEN seen END AS refers_to, true AS intact
FROM last
"""


def op13_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf
       FROM (SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term), total),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT item_id, doc_id,
         sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN w USING (term) JOIN tf USING (term), total GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""


QUERIES = {
    "op1_token_shards": op1_token_shards,
    "op2_toxicity": op2_toxicity,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_simhash_dedup": op5_simhash_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_html_text": op9_html_text,
    "op10_source_mixing": op10_source_mixing,
    "op11_collocations": op11_collocations,
    "op12_warc": op12_warc,
    "op13_lexical_search": op13_lexical_search,
}

SQL = {
    "op3_chat_format": OP3_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op11_collocations": OP11_SQL,
    "op12_warc": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
