"""Filtered top-k search and clause-to-policy matching."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausemill.functions.text import character_runs
from clausemill.functions.vectors import cosine_similarity, has_dimension, literal_vector
from clausemill.operators.knn import RANK_DIGITS, SIMILARITY_DIGITS, knn_join_exact, knn_join_scoped
from clausemill.session import saved

DEFAULT_TOP_K = 5
MAX_TOP_K = 50
MATCH_THRESHOLD = 0.60


class InvalidRequest(ValueError):
    """A request parameter is out of range."""


def check_query(query: str) -> str:
    if not query.strip():
        raise InvalidRequest("Query cannot be empty")
    return query.strip()


def search_limit(top_k: int | None) -> int:
    """The limit of a search; 0 means the default here."""
    limit = top_k or DEFAULT_TOP_K
    if not 1 <= limit <= MAX_TOP_K:
        raise InvalidRequest(f"top_k must be between 1 and {MAX_TOP_K}")
    return limit


def match_limit(top_k: int | None) -> int:
    """The limit of a match; 0 is an error here."""
    limit = DEFAULT_TOP_K if top_k is None else top_k
    if not 1 <= limit <= MAX_TOP_K:
        raise InvalidRequest(f"top_k must be between 1 and {MAX_TOP_K}")
    return limit


def check_threshold(value: float | None, name: str = "min_similarity") -> float | None:
    if value is not None and not 0.0 <= value <= 1.0:
        raise InvalidRequest(f"{name} must be between 0.0 and 1.0")
    return value


def request_rejection(query: Column, top_k: Column, threshold: Column) -> Column:
    """The same checks for a table of search requests: a reason, or null."""
    limit = F.coalesce(F.nullif(top_k, F.lit(0)), F.lit(DEFAULT_TOP_K))
    return (
        F.when(F.trim(F.coalesce(query, F.lit(""))) == "", F.lit("Query cannot be empty"))
        .when(~limit.between(1, MAX_TOP_K), F.lit(f"top_k must be between 1 and {MAX_TOP_K}"))
        .when(
            threshold.isNotNull() & ~threshold.between(0.0, 1.0),
            F.lit("min_similarity must be between 0.0 and 1.0"),
        )
    )


@dataclass(frozen=True)
class Filters:
    regulator: str | None = None
    jurisdiction: str | None = None
    document_id: object | None = None
    document_type: str | None = None
    section: str | None = None
    effective_date: object | None = None
    clause_number: str | None = None


def join_clause_catalog(
    clauses: DataFrame, versions: DataFrame, regulations: DataFrame, regulators: DataFrame
) -> DataFrame:
    """Embedded clauses of completed versions with their catalog fields.

    clauses(clause_id, version_id, clause_number, section, text, page_number,
    metadata struct, embedding).  Catalog fields are prefixed ``r_`` so that the
    metadata-or-column filters can see both.
    """
    done = versions.where(F.col("status") == "completed").select("version_id", "regulation_id", "effective_date")
    regs = regulations.select(
        "regulation_id",
        F.col("regulator_code").alias("r_regulator"),
        F.col("title").alias("r_title"),
        F.col("document_type").alias("r_document_type"),
    )
    places = regulators.select(F.col("code").alias("r_regulator"), F.col("jurisdiction").alias("r_jurisdiction"))
    return (
        clauses.where(F.col("embedding").isNotNull())
        .join(done, "version_id")
        .join(regs, "regulation_id")
        .join(places, "r_regulator")
        .select(
            "clause_id",
            F.col("version_id").alias("document_id"),
            F.coalesce("metadata.document_name", "r_title").alias("document_name"),
            F.coalesce("metadata.regulator", "r_regulator").alias("regulator"),
            "clause_number",
            "section",
            "text",
            "page_number",
            "metadata",
            "embedding",
            "r_regulator",
            "r_jurisdiction",
            "r_document_type",
            "effective_date",
        )
    )


def apply_filters(catalog: DataFrame, filters: Filters) -> DataFrame:
    def either(column: str, field: str, value: str) -> Column:
        return (F.col(column) == value) | (F.col(f"metadata.{field}") == value)

    conditions = []
    if filters.regulator:
        conditions.append(either("r_regulator", "regulator", filters.regulator))
    if filters.jurisdiction:
        conditions.append(either("r_jurisdiction", "jurisdiction", filters.jurisdiction))
    if filters.document_id:
        conditions.append(F.col("document_id") == F.lit(filters.document_id))
    if filters.document_type:
        conditions.append(either("r_document_type", "document_type", filters.document_type))
    if filters.section:
        conditions.append(F.col("section").ilike(f"%{filters.section}%"))
    if filters.effective_date:
        conditions.append(F.col("effective_date") == F.lit(filters.effective_date))
    if filters.clause_number:
        conditions.append(F.col("clause_number") == filters.clause_number)
    for condition in conditions:
        catalog = catalog.where(condition)
    return catalog


def _scored(rows: DataFrame, query_vector: list[float] | Column, vector_col: str = "embedding") -> DataFrame:
    """Add ``_sim``.  The query may be a scalar subquery, which must be a column of its own."""
    vector = query_vector if isinstance(query_vector, Column) else literal_vector(query_vector)
    return (
        rows.withColumn("_query", vector)
        .withColumn("_sim", cosine_similarity(F.col(vector_col), F.col("_query")))
        .drop("_query")
    )


def search_topk(
    catalog: DataFrame,
    query_vector: list[float] | Column,
    *,
    top_k: int | None = None,
    filters: Filters = Filters(),
    min_similarity: float | None = None,
    id_col: str = "clause_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Best clauses for one query vector: a narrow scan and TakeOrderedAndProject."""
    limit = search_limit(top_k)
    check_threshold(min_similarity)
    scored = _scored(apply_filters(catalog, filters), query_vector, vector_col).where(F.col("_sim").isNotNull())
    if min_similarity is not None:
        scored = scored.where(F.col("_sim") >= min_similarity)
    return (
        scored.orderBy(F.desc(F.round("_sim", RANK_DIGITS)), id_col)
        .limit(limit)
        .withColumn("similarity", F.round("_sim", SIMILARITY_DIGITS))
        .drop("_sim", vector_col)
    )


def search_many(
    catalog: DataFrame,
    queries: DataFrame,
    *,
    top_k: int | None = None,
    filters: Filters = Filters(),
    min_similarity: float | None = None,
) -> DataFrame:
    """queries(query_id, vector) against the filtered catalog: (query_id, clause_id, similarity, rank)."""
    limit = search_limit(top_k)
    check_threshold(min_similarity)
    left = queries.select(F.col("query_id").alias("left_id"), "vector")
    right = apply_filters(catalog, filters).select(F.col("clause_id").alias("right_id"), F.col("embedding").alias("vector"))
    hits = knn_join_exact(left, right, limit, threshold=min_similarity)
    return hits.select(F.col("left_id").alias("query_id"), F.col("right_id").alias("clause_id"), "similarity", "rank")


def searchable_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is processed and belongs to the same organisation."""
    docs = documents.where(F.col("status") == "processed").select(
        "document_id", "organization_id", "document_name", "document_type", F.col("version").alias("document_version")
    )
    return chunks.join(docs, ["document_id", "organization_id"])


def search_org_policies(
    chunks: DataFrame,
    documents: DataFrame,
    queries: DataFrame,
    *,
    top_k: int | None = None,
    min_similarity: float | None = None,
    document_id: object | None = None,
) -> DataFrame:
    """queries(query_id, organization_id, vector): top-k over the query's own organisation.

    Returns the hits with their chunk's and document's fields.  The
    organisation is part of the cell's key, so a query meets the chunks of its
    own organisation only, and a large organisation is still cut into cells.
    """
    limit = search_limit(top_k)
    check_threshold(min_similarity)
    scoped = searchable_chunks(chunks, documents)
    if document_id is not None:
        scoped = scoped.where(F.col("document_id") == F.lit(document_id))
    left = queries.select(F.col("query_id").alias("left_id"), F.col("organization_id").alias("scope"), "vector")
    right = scoped.select(
        F.col("chunk_id").alias("right_id"), F.col("organization_id").alias("scope"), F.col("embedding").alias("vector")
    )
    hits = knn_join_scoped(left, right, limit, threshold=min_similarity).select(
        F.col("left_id").alias("query_id"),
        F.col("scope").alias("organization_id"),
        F.col("right_id").alias("chunk_id"),
        "similarity",
        "rank",
    )
    return hits.join(chunk_fields(scoped), ["chunk_id", "organization_id"])


#: What a hit tells of its chunk, where the chunks have it.
CHUNK_FIELDS = (
    "document_id", "document_name", "document_type", "document_version", "content", "section_title", "clause_reference", "chunk_index",
)


def chunk_fields(scoped: DataFrame) -> DataFrame:
    return scoped.select("chunk_id", "organization_id", *[c for c in CHUNK_FIELDS if c in scoped.columns])


def check_dimensions(rows: DataFrame, dim: int, vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows of the expected dimension, other embedded rows with an error text)."""
    fits = has_dimension(F.col(vector_col), dim)
    message = F.concat(
        F.lit("Embedding dimension "), F.size(vector_col).cast("string"), F.lit(f" does not match expected {dim}")
    )
    return rows.where(fits), rows.where(F.col(vector_col).isNotNull() & ~fits).withColumn("error", message)


def match_clause_to_policy(
    clauses: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    *,
    top_k: int | None = None,
    similarity_threshold: float | None = None,
) -> DataFrame:
    """Every clause against the chunks of every organisation.

    clauses(clause_id, embedding), chunks(chunk_id, document_id,
    organization_id, embedding, ...) -> (organization_id, clause_id, chunk_id,
    similarity, rank).  The organisation is the scope of the grid, so clauses
    are replicated per block of chunks, not per organisation.
    """
    limit = match_limit(top_k)
    threshold = check_threshold(
        MATCH_THRESHOLD if similarity_threshold is None else similarity_threshold, "similarity_threshold"
    )
    left = clauses.select(F.col("clause_id").alias("left_id"), F.col("embedding").alias("vector"))
    right = searchable_chunks(chunks, documents).select(
        F.col("chunk_id").alias("right_id"), F.col("organization_id").alias("scope"), F.col("embedding").alias("vector")
    )
    return knn_join_exact(left, right, limit, threshold=threshold).select(
        F.col("scope").alias("organization_id"),
        F.col("left_id").alias("clause_id"),
        F.col("right_id").alias("chunk_id"),
        "similarity",
        "rank",
    )


def match_fields(matches: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """``match_clause_to_policy`` rows with the fields of their chunk and document."""
    return matches.join(chunk_fields(searchable_chunks(chunks, documents)), ["chunk_id", "organization_id"])


def _not_found(what: str, column: str) -> Column:
    return F.concat(F.lit(f"{what} '"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit("' not found"))


def match_requests(
    requests: DataFrame,
    organizations: DataFrame,
    clauses: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    *,
    dim: int,
) -> tuple[DataFrame, DataFrame]:
    """Requests(request_id, organization_id, clause_id, top_k, similarity_threshold) as (hits, refused requests).

    A request without k or threshold takes the defaults.  Hits carry the fields
    of chunk and document; a refused request says why: an argument out of
    range, an unknown organisation or clause, a clause without a vector of
    dimension ``dim``, in this order.  Each request meets its own organisation.
    """
    known = organizations.select("organization_id", F.lit(True).alias("_org")).distinct()
    found = clauses.select("clause_id", F.lit(True).alias("_clause"), F.col("embedding").alias("vector"))
    limit = F.coalesce("top_k", F.lit(DEFAULT_TOP_K))
    threshold = F.coalesce("similarity_threshold", F.lit(MATCH_THRESHOLD))
    size = F.coalesce(F.size("vector"), F.lit(0))
    # The messages.
    error = (
        F.when(~limit.between(1, MAX_TOP_K), F.lit(f"top_k must be between 1 and {MAX_TOP_K}"))
        .when(~threshold.between(0.0, 1.0) | F.isnan(threshold), F.lit("similarity_threshold must be between 0.0 and 1.0"))
        .when(F.col("_org").isNull(), _not_found("Organization", "organization_id"))
        .when(F.col("_clause").isNull(), _not_found("Regulatory clause", "clause_id"))
        .when(size != dim, F.concat(F.lit("Embedding dimension "), size.cast("string"), F.lit(f" does not match expected {dim}")))
    )
    checked = requests.join(known, "organization_id", "left").join(found, "clause_id", "left").withColumn("error", error)
    refused = checked.where(F.col("error").isNotNull()).select("request_id", "organization_id", "clause_id", "error")
    asked = checked.where(F.col("error").isNull()).withColumn("_limit", limit).withColumn("_threshold", threshold)
    scoped = searchable_chunks(chunks, documents)
    best = knn_join_scoped(
        asked.select(F.col("request_id").alias("left_id"), F.col("organization_id").alias("scope"), "vector"),
        scoped.select(F.col("chunk_id").alias("right_id"), F.col("organization_id").alias("scope"), F.col("embedding").alias("vector")),
        MAX_TOP_K,
        dim=dim,
        digits=None,
    )
    hits = (
        best.select(F.col("left_id").alias("request_id"), F.col("right_id").alias("chunk_id"), "similarity", "rank")
        .join(asked.select("request_id", "organization_id", "clause_id", "_limit", "_threshold"), "request_id")
        .where((F.col("rank") <= F.col("_limit")) & (F.col("similarity") >= F.col("_threshold")))
        .drop("_limit", "_threshold")
        .withColumn("similarity", F.round("similarity", SIMILARITY_DIGITS))
    )
    return hits.join(chunk_fields(scoped), ["chunk_id", "organization_id"]), refused


def payload_filter_search(
    points: DataFrame,
    query_vector: list[float] | Column,
    *,
    top_k: int = 10,
    filters: Mapping[str, object] | None = None,
    mode: str = "all",
) -> DataFrame:
    """points(id, vector, payload columns): equality filters, all ANDed.

    A list value adds one equality per element; with ``mode="all"`` they are
    ANDed as well, so two different values match nothing.  ``mode="any"`` reads
    a list as IN.
    """
    for name, value in (filters or {}).items():
        if not isinstance(value, list):
            points = points.where(F.col(name) == value)
        elif mode == "any":
            points = points.where(F.col(name).isin(value))
        else:
            for item in value:
                points = points.where(F.col(name) == item)
    return (
        _scored(points, query_vector, "vector")
        .orderBy(F.desc(F.round("_sim", RANK_DIGITS)), "id")
        .limit(top_k)
        .withColumn("score", F.round("_sim", SIMILARITY_DIGITS))
        .drop("vector", "_sim")
    )


def top_similarity_debug(clauses: DataFrame, query_vector: list[float] | Column, *, limit: int = 10) -> DataFrame:
    """Unfiltered best clauses with distance, similarity and a 70-character preview."""
    return (
        _scored(clauses.where(F.col("embedding").isNotNull()), query_vector)
        .orderBy(F.desc(F.round("_sim", RANK_DIGITS)), "clause_id")
        .limit(limit)
        .select(
            "clause_id",
            F.substring("text", 1, 70).alias("text_preview"),
            F.coalesce("metadata.document_name", F.lit("unknown")).alias("doc_name"),
            F.round("_sim", SIMILARITY_DIGITS).alias("similarity"),
        )
        .withColumn("cosine_distance", F.round(1 - F.col("similarity"), SIMILARITY_DIGITS))
    )


def like_probe(clauses: DataFrame, pattern: str, query_vector: list[float] | Column) -> DataFrame:
    """Distance and similarity of all clauses whose text matches a LIKE pattern."""
    return _scored(clauses.where(F.col("text").like(pattern)), query_vector).select(
        "clause_id",
        F.round("_sim", SIMILARITY_DIGITS).alias("similarity"),
        F.round(1 - F.col("_sim"), SIMILARITY_DIGITS).alias("cosine_distance"),
    )


PREFIX_CHARS = 80
ANCHOR_WORDS = 3
#: So many anchors are compared with every text before its anchors become rows.
FEW_ANCHORS = 4096
SHORT_ANCHOR_CHARS = 3
_WORD_BREAK = r"[^\p{L}\p{N}]+"


def _like_pattern(content: Column, chars: int) -> Column:
    """%first characters%, with escapes no LIKE dialect refuses: '\\x' means x."""
    prefix = F.substring(content, 1, chars)
    return F.concat(F.lit("%"), F.regexp_replace(prefix, r"(\\[%_\\])|\\(.)", "$1$2"), F.lit("%"))


def _phrases(words: Column, n: int) -> Column:
    """All runs of n words; words beyond the end are null and end the list."""
    if n == 1:
        return words
    return F.slice(
        F.transform(
            words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + j) for j in range(1, n)])
        ),
        F.lit(1),
        F.greatest(F.size(words) - (n - 1), F.lit(0)),
    )


def text_fallback_match(
    chunks: DataFrame, clauses: DataFrame, *, top_k: int | None = None, prefix_chars: int = PREFIX_CHARS
) -> DataFrame:
    """Clauses whose text contains, ignoring case, the first ``prefix_chars`` characters of a chunk.

    chunks(chunk_id, content), clauses(clause_id, text) -> (chunk_id,
    clause_id, rank), the k smallest clause ids per chunk.  ``%`` and ``_`` in
    the chunk stay wildcards.

    An equi-join on anchors finds candidates, the LIKE test decides. The words
    inside a wildcard-free stretch of the prefix, without its first and last
    (which may be cut), must all stand as whole words in a matching text: any
    three of them in a row (or fewer, if there are no more) can be the anchor.
    Prefixes without such a word take three, two or one characters in a row of
    a stretch. Of a prefix's anchors the one that the fewest texts hold is
    looked for; a prefix with an anchor that no text holds has no match. A
    prefix of wildcards alone asks for a length only.

    Texts are taken apart into the kinds of anchors that some prefix asks for;
    while at most ``FEW_ANCHORS`` are asked for, only those become rows, else
    all do and the join drops the others.

    Prefixes, and the places of their anchors, are written to the shared folder
    when the function is called: both are read several times, and a plan that
    repeats the steps before them is slower to plan than to run.
    """
    limit = match_limit(top_k)
    prefix = F.substring("content", 1, prefix_chars)
    # Step by step: an expression that names a long one several times is compiled as often.
    cut = chunks.where(F.col("content").isNotNull()).select(
        "chunk_id",
        _like_pattern(F.col("content"), prefix_chars).alias("_like"),
        # What stands before a backslash is escaped and thus a character; the count only has to be no larger than needed.
        F.length(F.regexp_replace(F.regexp_replace(prefix, r"\\.?", ""), "[^_]", "")).alias("_least"),
        F.split(F.lower(prefix), r"[%_\\]").alias("_stretches"),
    )
    # The first and last token are cut words, or '' beside a break; both are left out.
    tokens = F.transform("_stretches", lambda s: F.split(s, _WORD_BREAK))
    inner = F.transform(tokens, lambda ws: F.filter(F.slice(ws, 2, F.greatest(F.size(ws) - 2, F.lit(0))), lambda w: w != ""))
    longest = F.array_max(F.transform(inner, lambda ws: F.struct(F.size(ws).alias("n"), ws.alias("ws"))))
    literal = F.array_max(F.transform("_stretches", lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    measured = cut.select("chunk_id", "_like", "_least", longest.alias("_longest"), literal.alias("_literal")).select(
        "chunk_id",
        "_like",
        "_least",
        F.col("_longest.ws").alias("_ws"),
        F.least("_longest.n", F.lit(ANCHOR_WORDS)).alias("_words_n"),
        F.col("_literal.s").alias("_chars"),
        F.filter(F.split("_literal.s", ""), lambda c: c != "").alias("_ls"),
        F.least("_literal.n", F.lit(SHORT_ANCHOR_CHARS)).alias("_chars_n"),
    )
    words_n, chars_n = F.col("_words_n"), F.col("_chars_n")
    anchors = (
        F.when(words_n == ANCHOR_WORDS, _phrases(F.col("_ws"), ANCHOR_WORDS))
        .when(words_n > 0, F.array(F.array_join("_ws", " ")))
        .when(chars_n == SHORT_ANCHOR_CHARS, character_runs(F.col("_ls"), SHORT_ANCHOR_CHARS))
        .otherwise(F.array("_chars"))
    )
    # Every pattern is matched once and cut to its k clauses, however many chunks share it.
    prefixes = saved(
        measured.select(
            "chunk_id",
            "_like",
            F.when(words_n > 0, F.concat(F.lit("w"), words_n.cast("string")))
            .when(chars_n > 0, F.concat(F.lit("c"), chars_n.cast("string")))
            .alias("_kind"),
            anchors.alias("_anchors"),
            "_least",
        ),
        "prefixes",
    )
    asked = prefixes.select("chunk_id", "_like")
    patterns = prefixes.drop("chunk_id").dropDuplicates(["_like"])
    texts = clauses.select("clause_id", "text").where(F.col("text").isNotNull())
    wanted = patterns.where(F.col("_kind").isNotNull()).select("_like", "_kind", F.explode("_anchors").alias("_anchor"))

    # One row of bounded size each: the kinds (at most six) and, while they are few, the anchors asked for.
    kinds = patterns.agg(F.collect_set("_kind")).scalar()
    few = wanted.select("_anchor").distinct().limit(FEW_ANCHORS + 1).agg(F.collect_set("_anchor")).scalar()

    def held(values: Column) -> Column:
        return F.when(F.size(few) <= FEW_ANCHORS, F.array_intersect(values, few)).otherwise(F.array_distinct(values))

    def entries(kind: str, values: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), F.when(F.array_contains(kinds, kind), held(values)).alias("_held"))

    letter_kinds = F.array(*[F.lit(f"c{n}") for n in range(1, SHORT_ANCHOR_CHARS + 1)])
    taken_apart = texts.select(
        "clause_id",
        F.filter(F.split(F.lower("text"), _WORD_BREAK), lambda w: w != "").alias("_ws"),
        F.when(F.arrays_overlap(kinds, letter_kinds), F.filter(F.split(F.lower("text"), ""), lambda c: c != "")).alias("_ls"),
    )
    found = [entries(f"w{n}", _phrases(F.col("_ws"), n)) for n in range(1, ANCHOR_WORDS + 1)]
    found += [entries(f"c{n}", character_runs(F.col("_ls"), n)) for n in range(1, SHORT_ANCHOR_CHARS + 1)]
    by_kind = taken_apart.select("clause_id", F.explode(F.array(*found)).alias("_e")).select("clause_id", "_e._kind", F.explode("_e._held").alias("_anchor"))
    holders = by_kind.join(wanted.select("_kind", "_anchor").distinct(), ["_kind", "_anchor"], "left_semi")
    # The counts and the candidates read the same files, so texts are taken apart once.
    holders = saved(holders, "anchors")
    often = holders.groupBy("_kind", "_anchor").agg(F.count("clause_id").alias("_n"))
    weighed = wanted.join(often, ["_kind", "_anchor"], "left").groupBy("_like", "_kind")
    chosen = weighed.agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_anchor").alias("anchor"))).alias("_a"))
    rarest = chosen.where("_a.n > 0").select("_like", "_kind", F.col("_a.anchor").alias("_anchor"))
    candidates = holders.join(rarest, ["_kind", "_anchor"])

    # Wildcards alone: the lengths asked for, at most prefix_chars + 1 of them, meet the texts that are long enough.
    open_ = patterns.where(F.col("_kind").isNull())
    lengths = open_.agg(F.collect_set("_least")).scalar()
    long_enough = texts.select("clause_id", F.length("text").alias("_n"), lengths.alias("_asked")).select(
        "clause_id", F.explode(F.filter("_asked", lambda n: n <= F.col("_n"))).alias("_least")
    )
    by_length = long_enough.join(open_.select("_like", "_least"), "_least").select("_like", "clause_id")
    pairs = candidates.select("_like", "clause_id").unionByName(by_length)
    matched = pairs.join(texts, "clause_id").where(F.expr("text ilike _like")).select("_like", "clause_id")
    order = Window.partitionBy("_like").orderBy("clause_id")
    best = matched.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.join(best, "_like").select("chunk_id", "clause_id", "rank")
