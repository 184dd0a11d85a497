"""Map styles of features from layer renderers (JSON text per item_id and layer_index)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import colour_hex, colour_opacity

_SYMBOL = "STRUCT<color: ARRAY<INT>, outline: STRUCT<color: ARRAY<INT>, width: DOUBLE>>"
_RENDERER = (
    "type STRING, symbol " + _SYMBOL + ", field1 STRING, field2 STRING, field3 STRING, "
    "fieldDelimiter STRING, defaultSymbol " + _SYMBOL + ", "
    "uniqueValueInfos ARRAY<STRUCT<value: STRING, symbol: " + _SYMBOL + ">>"
)
_KEY = ["item_id", "layer_index"]
_STYLE_TYPES = {
    "fill_color": "string", "color": "string", "weight": "double", "fill_opacity": "double", "opacity": "double",
}
STYLE = tuple(_STYLE_TYPES)


def _style(symbol: str, fixed_width: bool = False) -> Column:
    width = F.lit(1.0) if fixed_width else F.coalesce(F.col(f"{symbol}.outline.width"), F.lit(1.0))
    fill, line = F.col(f"{symbol}.color"), F.col(f"{symbol}.outline.color")
    return F.struct(
        colour_hex(fill).alias("fill_color"),
        colour_hex(line).alias("color"),
        width.alias("weight"),
        colour_opacity(fill).alias("fill_opacity"),
        colour_opacity(line).alias("opacity"),
    )


def parse_renderers(renderers: DataFrame) -> DataFrame:
    """Per layer: the renderer's fields, ``constant`` (simple) and ``fallback`` (default symbol)."""
    parsed = renderers.select(*_KEY, F.from_json("renderer", _RENDERER).alias("r"))
    return parsed.select(
        *_KEY,
        F.col("r.type").alias("renderer_type"),
        *[F.nullif(F.col(f"r.field{i}"), F.lit("")).alias(f"field{i}") for i in (1, 2, 3)],
        F.coalesce("r.fieldDelimiter", F.lit(",")).alias("delimiter"),
        F.when(F.col("r.type") == "simple", _style("r.symbol")).alias("constant"),
        F.when(F.col("r.defaultSymbol").isNotNull(), _style("r.defaultSymbol", fixed_width=True)).alias("fallback"),
    )


def class_styles(renderers: DataFrame) -> DataFrame:
    """One style per (layer, class key); of repeated values the last one counts."""
    infos = renderers.select(*_KEY, F.from_json("renderer", _RENDERER).alias("r")).filter(
        F.col("r.type") == "uniqueValue"
    )
    return (
        infos.select(*_KEY, F.posexplode("r.uniqueValueInfos").alias("position", "info"))
        .select(*_KEY, F.col("info.value").alias("class_key"), "position", _style("info.symbol").alias("class_style"))
        .groupBy(*_KEY, "class_key")
        .agg(F.max_by("class_style", "position").alias("class_style"))
    )


def _attribute(features: DataFrame, field: str) -> str:
    """SQL text of the attribute that ``field`` names, as text; a null reads "None", an unknown name empty."""
    choices = []
    for name, kind in features.dtypes:
        if kind.startswith(("array", "map", "struct", "variant", "binary")) or name == "geometry":
            continue
        quoted = "`" + name.replace("`", "``") + "`"
        text = f"CAST({quoted} AS STRING)"
        text = f"initcap({text})" if kind == "boolean" else text
        label = name.replace("\\", "\\\\").replace("'", "\\'")
        choices.append(f"WHEN '{label}' THEN coalesce({text}, 'None')")
    return f"CASE {field} {' '.join(choices)} ELSE '' END" if choices else "''"


def style_features(
    features: DataFrame, renderers: DataFrame, default: dict[str, str | float]
) -> DataFrame:
    """Features with the columns of their style.

    Order of precedence: simple symbol, class symbol, default symbol, the caller's ``default``.
    Both lookups are small next to the features and are broadcast when their size allows; if not,
    a hot class or layer can be split at run time, as the features are the left side.
    """
    parsed = parse_renderers(renderers)
    layer = parsed.select(*_KEY, F.struct(*[c for c in parsed.columns if c not in _KEY]).alias("_layer"))
    # The up to three attributes of the key are chosen by name once the renderer is known.
    named = lambda i: _attribute(features, f"_layer.field{i}")
    more = [
        f"CASE WHEN _layer.field{i} IS NULL THEN '' ELSE concat(_layer.delimiter, {named(i)}) END" for i in (2, 3)
    ]
    class_key = F.expr(
        f"CASE WHEN _layer.renderer_type = 'uniqueValue' THEN concat({named(1)}, {', '.join(more)}) END"
    )
    classes = class_styles(renderers).withColumnsRenamed({"class_key": "_key", "class_style": "_class"})
    styled = (
        features.join(layer, _KEY, "left")
        .withColumn("_key", class_key)
        .join(classes, [*_KEY, "_key"], "left")
    )
    given = F.struct(*[F.lit(default.get(n)).cast(_STYLE_TYPES[n]).alias(n) for n in STYLE])
    style = F.coalesce("_layer.constant", "_class", "_layer.fallback", given).alias("_style")
    return styled.select(*features.columns, style).select(*features.columns, "_style.*")


def style_diversity(styled: DataFrame) -> DataFrame:
    """How many fill colours each layer shows, and which."""
    colours = styled.select(*_KEY, "fill_color").distinct()
    return colours.groupBy(*_KEY).agg(
        F.count("fill_color").alias("n_colors"),
        F.array_join(F.array_sort(F.collect_list("fill_color")), ",").alias("colors"),
    )
