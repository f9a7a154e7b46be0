"""Documents -> passages, all in SQL expressions (no Python in the hot path).

Flat form (default): one row per passage
    (doc_id, [carried columns], passage_idx INT, passage_id STRING, passage_body STRING)
Nested form: ``passages ARRAY<STRUCT<passage_idx, passage_id, passage_body>>`` per doc.

Splitting is a narrow transformation (split -> sequence -> transform -> posexplode):
no shuffle, and every document is processed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankweave.defaults import PASSAGE_SIZE, TOKEN_MARGIN


def drop_empty(df: DataFrame, body: str = "body") -> DataFrame:
    """Keep documents whose body is neither null nor empty."""
    return df.where(F.col(body).isNotNull() & (F.col(body) != ""))


def _title_prefix(title: str) -> Column:
    t = F.col(title)
    return F.when(t.isNotNull() & (t != ""), F.concat(t, F.lit(" "))).otherwise(F.lit(""))


def passage_bodies(tokens: Column, passage_size: int, prefix: Column | None = None) -> Column:
    """ARRAY<STRING> of passages from a token array (the body split on single
    spaces, empty tokens kept): consecutive windows of ``passage_size`` tokens
    joined by a space, each preceded by ``prefix``. Null tokens -> empty array.

    ``tokens`` should be a column reference: an inline ``split(...)`` would be
    evaluated again for every passage inside the lambda.
    """
    if passage_size < 1:
        raise ValueError("passage_size must be >= 1")
    starts = F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(passage_size))
    pref = prefix if prefix is not None else F.lit("")
    chunks = F.transform(starts, lambda i: F.concat(pref, F.array_join(F.slice(tokens, i + 1, passage_size), " ")))
    return F.when(tokens.isNull(), F.array().cast("array<string>")).otherwise(chunks)


def split_passages(df: DataFrame, passage_size: int = PASSAGE_SIZE, prepend_title: bool = True, *, doc_id: str = "doc_id",
                   title: str = "title", body: str = "body", keep: list[str] | None = None,
                   nested: bool = False) -> DataFrame:
    """Split documents into passages by spaces (flat unless ``nested``).

    The title (when non-null and non-empty) plus one space is put in front of
    every passage and does not count against ``passage_size``. ``passage_id`` is
    ``doc_id || '_' || passage_idx``. The body column is dropped; ``keep`` lists
    other document columns to carry (default: all but the body).
    """
    keep = [c for c in df.columns if c not in (body, doc_id)] if keep is None else list(keep)
    extra = [title] if prepend_title and title not in keep else []
    toks = df.select(doc_id, *keep, *extra, F.split(F.col(body), " ", -1).alias("_toks"))
    prefixed = toks.withColumn("_prefix", _title_prefix(title)) if prepend_title else toks
    arr = passage_bodies(F.col("_toks"), passage_size, F.col("_prefix") if prepend_title else None)
    if nested:
        structs = F.transform(arr, lambda p, i: F.struct(
            i.cast("int").alias("passage_idx"),
            F.concat(F.col(doc_id), F.lit("_"), i.cast("string")).alias("passage_id"),
            p.alias("passage_body")))
        return prefixed.select(doc_id, *keep, structs.alias("passages"))
    exploded = prefixed.select(doc_id, *keep, F.posexplode(arr).alias("passage_idx", "passage_body"))
    return exploded.select(doc_id, *keep, F.col("passage_idx").cast("int").alias("passage_idx"),
                           F.concat(F.col(doc_id), F.lit("_"), F.col("passage_idx").cast("string")).alias("passage_id"),
                           "passage_body")


def _first(tokens: Column, n: int | None) -> Column:
    return tokens if n is None else F.slice(tokens, 1, n)


def token_passages(title_tokens: Column, body_tokens: Column, passage_size: int, prepend_title: bool = True,
                   title_cap: int | None = None, margin: int = TOKEN_MARGIN, elem_type: str = "string") -> Column:
    """ARRAY<ARRAY<token>>: body tokens in chunks of ``passage_size - len(title) - margin``,
    each preceded by the title tokens (the first ``title_cap``, if given). A chunk length
    <= 0 raises an error at run time. Empty or null body -> no passage."""
    if passage_size - margin <= 0:
        raise ValueError(f"no room for passage text: passage_size {passage_size} <= margin {margin}")
    empty = F.array().cast(f"array<{elem_type}>")
    title = F.coalesce(_first(title_tokens, title_cap), empty) if prepend_title else empty
    chunk = F.lit(passage_size) - F.size(title) - F.lit(margin)
    n = F.when(body_tokens.isNull(), F.lit(0)).otherwise(F.size(body_tokens))
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), n - 1, F.greatest(chunk, F.lit(1))))
    parts = F.transform(starts, lambda i: F.concat(title, F.slice(body_tokens, i + 1, chunk)))
    error = F.raise_error(F.concat(F.lit(f"no room for passage text: passage_size {passage_size} leaves "),
                                   chunk.cast("string"), F.lit(" tokens after the title and the margin")))
    return F.when(chunk <= 0, error).otherwise(parts)


def split_token_passages(df: DataFrame, passage_size: int = PASSAGE_SIZE, prepend_title: bool = True, *,
                         doc_id: str = "doc_id", title_tokens: str = "title_tokens",
                         body_tokens: str = "body_tokens", title_cap: int | None = None, margin: int = TOKEN_MARGIN,
                         keep: list[str] | None = None) -> DataFrame:
    """Token-based split on token arrays produced by a user tokenizer.

    Flat rows (doc_id, [keep], passage_idx, passage_id, passage_tokens).
    """
    keep = [] if keep is None else list(keep)
    elem = df.schema[body_tokens].dataType.elementType.simpleString()
    empty = F.array().cast(f"array<{elem}>")
    capped = df.withColumn("_title", F.coalesce(_first(F.col(title_tokens), title_cap), empty))
    arr = token_passages(F.col("_title"), F.col(body_tokens), passage_size, prepend_title, title_cap, margin,
                         elem_type=elem)
    exploded = capped.select(doc_id, *keep, F.posexplode(arr).alias("passage_idx", "passage_tokens"))
    return exploded.select(doc_id, *keep, F.col("passage_idx").cast("int").alias("passage_idx"),
                           F.concat(F.col(doc_id), F.lit("_"), F.col("passage_idx").cast("string")).alias("passage_id"),
                           "passage_tokens")


def flatten(df: DataFrame, passages: str = "passages", *, doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """Nested passages -> one row per passage, document order kept in passage_idx."""
    keep = [c for c in df.columns if c not in (passages, doc_id)] if keep is None else list(keep)
    return df.select(doc_id, *keep, F.inline(F.col(passages)))


def nest(df: DataFrame, *, doc_id: str = "doc_id", order: str = "passage_idx", fields: list[str] | None = None,
         out_col: str = "passages", max_passages: int | None = None) -> DataFrame:
    """Flat passages -> one row per document with its passages as an array in
    numeric ``order`` (``_2`` before ``_10``).

    The array is the document's own row, so it is as large as the document;
    ``max_passages`` keeps only the first passages (the learned pooler's cap).
    """
    fields = [c for c in df.columns if c not in (doc_id,)] if fields is None else list(fields)
    if order not in fields:
        fields = [order] + fields
    else:
        fields = [order] + [f for f in fields if f != order]
    src = df if max_passages is None else df.where(F.col(order) < max_passages)
    agg = F.array_sort(F.collect_list(F.struct(*[F.col(f) for f in fields])))
    return src.groupBy(doc_id).agg(agg.alias(out_col))


def cap_passages(df: DataFrame, max_passages: int, *, order: str = "passage_idx") -> DataFrame:
    """Keep at most the first ``max_passages`` passages of each document (flat form)."""
    return df.where(F.col(order) < max_passages)


def split_passage_id(df: DataFrame, passage_id: str = "passage_id", *, doc_col: str = "doc_id",
                     idx_col: str = "passage_idx") -> DataFrame:
    """Parse ``<doc_id>_<n>`` into doc_id and passage number (doc ids contain no '_')."""
    parts = F.split(F.col(passage_id), "_", -1)
    return df.withColumn(doc_col, F.element_at(parts, 1)).withColumn(
        idx_col, F.element_at(parts, 2).cast("int"))
