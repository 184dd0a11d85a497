"""Raw item JSON to typed catalog rows."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical_digest, epoch_ms_to_ntz, ntz, split_tags
from ..functions.where import checked
from ..schemas import ITEMS_CURRENT
from .current import last_in_batch

# The raw fields whose change makes a new version. Views and creation do not.
HASHED_FIELDS = (
    "id", "title", "type", "owner", "url", "access",
    "tags", "snippet", "description", "thumbnail", "extent", "modified",
)

_NUMBER_TYPES = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


# SQL text of parts of ``item``, the parsed variant.


def _value(path: str, kind: str = "variant") -> str:
    """A member, null when absent; as a variant, one given as null is a variant null."""
    return f"try_variant_get(item, '$.{path}', '{kind}')"


def _text(name: str, default: str | None = None) -> str:
    text = _value(name, "string")
    return text if default is None else f"coalesce(nullif({text}, ''), '{default}')"


def _kind(name: str) -> str:
    return f"schema_of_variant({_value(name)})"


def _hashed(name: str) -> str:
    """Text of a field with its kind: quoted if it is a string, JSON if not, null without a value.

    The digest puts lengths before its fields, so the quotes only tell ``"5"`` from ``5``.
    """
    return f"""CASE WHEN {_kind(name)} = 'STRING' THEN concat('"', {_text(name)}, '"')
                    WHEN NOT is_variant_null({_value(name)}) THEN to_json({_value(name)}) END"""


_REASON = f"CASE WHEN item IS NULL THEN 'not JSON' WHEN {_text('id')} IS NULL THEN 'no item id' END"


def _moment(name: str) -> Column:
    number = f"CASE WHEN {_kind(name)} RLIKE '{_NUMBER_TYPES}' THEN {_value(name, 'double')} END"
    return epoch_ms_to_ntz(F.expr(number))


def _tags() -> Column:
    kind = F.expr(_kind("tags"))
    listed = F.when(kind.startswith("ARRAY"), F.expr(_value("tags", "array<string>")))
    split = listed.when(kind == "STRING", split_tags(F.expr(_text("tags"))))
    return F.coalesce(split, F.expr("CAST(array() AS ARRAY<STRING>)"))


def _extent() -> Column:
    """All four corners, or none when one is missing or not a number."""
    corners = {"xmin": "[0][0]", "ymin": "[0][1]", "xmax": "[1][0]", "ymax": "[1][1]"}
    values = {name: _value(f"extent{at}", "double") for name, at in corners.items()}
    whole = " AND ".join(f"{v} IS NOT NULL" for v in values.values())
    box = ", ".join(f"'{name}', {v}" for name, v in values.items())
    return F.expr(
        f"CASE WHEN size({_value('extent', 'array<variant>')}) = 2 AND {whole} THEN named_struct({box}) END"
    )


def parse_items(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Add ``item`` (variant); null where the text is not JSON."""
    return raw.withColumn("item", F.try_parse_json(column))


def _accepted(raw: DataFrame, column: str, carry: tuple[str, ...]) -> DataFrame:
    """``item`` of the rows that have an id.

    A filter on the id would be pushed below the parsing and so parse every text a second time;
    exploding a null drops the row just as well, and stays where it is.
    """
    item = F.expr(f"CASE WHEN {_text('id')} IS NOT NULL THEN array(item) END")
    return parse_items(raw, column).select(*carry, F.explode(item).alias("item"))


def normalize_items(
    raw: DataFrame, run_id: str, as_of: datetime | str, column: str = "raw", carry: tuple[str, ...] = ()
) -> DataFrame:
    """Typed rows of the accepted raw items, plus the ``carry`` columns (a batch position, say).

    Rows without an id or that are not JSON are left to :func:`rejected_items`.
    """
    return _typed(_accepted(raw, column, carry), run_id, as_of, carry)


def staged_items(raw: DataFrame, run_id: str, as_of: datetime | str, column: str = "raw", carry: tuple[str, ...] = ()) -> DataFrame:
    """Both kinds of raw rows from one parse, to be written once and read back by ``reason``.

    Accepted rows have a null ``reason``; rejected ones have no typed values but their raw text.
    """
    rejected = F.when(F.col("reason").isNotNull(), F.col(column)).alias(column)
    parsed = parse_items(raw, column).withColumn("reason", F.expr(_REASON)).select(*carry, "reason", rejected, "item")
    return _typed(parsed, run_id, as_of, (*carry, "reason", column))


def _typed(parsed: DataFrame, run_id: str, as_of: datetime | str, carry: tuple[str, ...]) -> DataFrame:
    """Catalog columns of ``item``, plus the ``carry`` columns."""
    texts = {
        "item_id": _text("id"),
        "title": _text("title", "Untitled"),
        "item_type": _text("type", "Unknown"),
        "owner": _text("owner", "Unknown"),
        "url": _text("url"),
        "access": _text("access"),
        "snippet": _text("snippet", ""),
        "description": _text("description", ""),
        "thumbnail": _text("thumbnail"),
        # Absent views are none, a null stays unknown.
        "num_views": f"CASE WHEN {_value('numViews')} IS NULL THEN 0 ELSE {_value('numViews', 'bigint')} END",
    }
    fields = parsed.select(
        *carry,
        *[F.expr(f"{text} AS {name}") for name, text in texts.items()],
        _moment("created").alias("created_at"),
        _moment("modified").alias("modified_at"),
        _tags().alias("tags"),
        _extent().alias("extent"),
        canonical_digest(*[F.expr(_hashed(f)) for f in HASHED_FIELDS]).alias("content_hash"),
    )
    derived = {
        "tags_json": "to_json(tags)",
        "tags_count": "size(tags)",
        "snippet_len": "length(snippet)",
        "description_len": "length(description)",
        "has_thumbnail": "coalesce(thumbnail <> '', false)",
        "has_description": "description <> ''",
        "has_extent": "extent IS NOT NULL",
        **{f"extent_{corner}": f"extent.{corner}" for corner in ("xmin", "ymin", "xmax", "ymax")},
    }
    full = fields.selectExpr("*", *[f"{text} AS {name}" for name, text in derived.items()]).withColumns(
        {"last_seen_run_id": F.lit(run_id), "last_seen_at": ntz(as_of)}
    )
    return full.select(*ITEMS_CURRENT.names, *carry)


def rejected_items(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Raw rows that cannot enter the catalog, with the reason."""
    reason = F.expr(_REASON)
    return parse_items(raw, column).select(
        *raw.columns, F.explode(F.array_compact(F.array(reason))).alias("reason")
    )


def scan_items(
    items: DataFrame,
    query: str | None = None,
    item_types: list[str] | None = None,
    max_items: int | None = None,
    last_wins: Sequence[str] = (),
) -> DataFrame:
    """Items matching a user's predicate (public ones by default), which is checked first, and any of the types.

    With ``last_wins`` an item seen repeatedly is reduced to its row of the greatest order first.
    ``max_items`` then keeps the first ones by id, so that a capped scan is repeatable.
    """
    out = items.filter(checked(items, query or "access = 'public'"))
    if item_types:
        out = out.filter(F.col("item_type").isin(*item_types))
    if last_wins:
        out = last_in_batch(out, *last_wins)
    return out if max_items is None else out.orderBy("item_id").limit(max_items)


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("run_id") == run_id)
