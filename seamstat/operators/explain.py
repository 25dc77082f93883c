"""Explanations of a score: which engineered features of a row stand out.

A row carries all its features, so every ranking here sorts a short array inside the row.
Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.schema import FEATURE_GROUPS, FEATURES, ID_COLUMN, IMAGE_FEATURES, Feature

# List lengths, cut-offs and display scales.
TOP_SIGNALS = 3
DRIVERS_PER_GROUP = 4
MATRIX_PER_MODALITY = 6
LABEL_WIDTH = 20
FAINT = 0.02
DISPLAY_SCALES = [("char_count", 400.0), ("word_count", 400.0), ("sentence_len", 400.0),
                  ("days_since", 60.0), ("comfort_hours", 12.0)]
UNIT_SURVEY_PARTS = """
likelihood loyalty sensitivity match importance formality difficulty buyer alternatives
worn gift odor contact alterations photo channel
""".split()
# End of fixed values.


# Ranked entries hold only magnitude, position and value. Names, groups and scales are looked
# up by position afterwards, for the few entries that are kept.


def _ranked(features: Sequence[Feature], limit: int | None = None) -> str:
    """SQL for the given features of a row, largest magnitude first, then column order."""
    entries = ", ".join(
        f"named_struct('rank_key', -abs(cast({f.name} as double)), 'position', {f.position}, "
        f"'value', cast({f.name} as double))"
        for f in features
    )
    ordered = f"sort_array(array({entries}))"
    return ordered if limit is None else f"slice({ordered}, 1, {limit})"


def _lookup(values: Sequence[str | float], position: str = "position") -> Column:
    """The value that belongs to a feature position."""
    listed = ", ".join(f'"{v}"' if isinstance(v, str) else f"{v}D" for v in values)
    return F.expr(f"element_at(array({listed}), {position} + 1)")


def _per_group(limit: int | None = None) -> dict[str, str]:
    return {
        modality: _ranked([f for f in FEATURES if f.modality == modality], limit)
        for _, modality, _, _ in FEATURE_GROUPS
    }


def spoken_label(name: str) -> str:
    for prefix in ("survey_", "nlp_", "vis_", "img_"):
        name = name.replace(prefix, "")
    return name.replace("_", " ")


GROUP_OF = [f.group for f in FEATURES]
NAME_OF = [f.name for f in FEATURES]
SPOKEN_OF = [spoken_label(f.name) for f in FEATURES]


def top_signals_sql(limit: int = TOP_SIGNALS) -> str:
    """SQL for the strongest features of the row over all groups."""
    return _ranked([f for f in FEATURES if f.name != "img_has_image"], limit)


def with_strongest(df: DataFrame, limit: int = TOP_SIGNALS) -> DataFrame:
    """Append ``strongest``: (position, value) of the strongest features over all groups.

    One sort of a short array inside the row; of equal magnitudes the first column, and NaN last.
    """
    told = F.transform(F.expr(top_signals_sql(limit)), lambda s: F.struct(s["position"].alias("position"), s["value"].alias("value")))
    return df.withColumn("strongest", told)


def top_signals(features: DataFrame, key: str = ID_COLUMN, limit: int = TOP_SIGNALS) -> DataFrame:
    ranked = features.select(key, F.posexplode(F.expr(top_signals_sql(limit))).alias("place", "s"))
    ranked = ranked.select(key, (F.col("place") + 1).alias("rank"), "s.position", "s.value")
    return ranked.select(
        key,
        "rank",
        _lookup(GROUP_OF).alias("group"),
        _lookup(NAME_OF).alias("feature"),
        _lookup(SPOKEN_OF).alias("label"),
        "value",
    )


def _unfold_groups(features: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows (key, rank, position, value), ranked within each group."""
    numbered = [
        f"transform({ranked}, (s, i) -> named_struct('rank', i + 1, 'position', s.position, "
        "'value', s.value))"
        for ranked in _per_group(limit).values()
    ]
    return features.select(key, F.expr(f"inline(concat({', '.join(numbered)}))"))


def feature_breakdown(features: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """All features of a row, by group, with their place in the group by magnitude."""
    return _unfold_groups(features, key).select(
        key,
        _lookup(GROUP_OF).alias("group"),
        _lookup(NAME_OF).alias("feature"),
        F.col("position").alias("ord"),
        "rank",
        "value",
    )


def breakdown_map() -> Column:
    """Group -> feature -> value for the row."""
    groups = [
        f'"{group}", map(' + ", ".join(f"'{n}', cast({n} as double)" for n in members) + ")"
        for group, _, _, members in FEATURE_GROUPS
    ]
    return F.expr(f"map({', '.join(groups)})")


def explained(scored: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Score, prediction, label and the whole breakdown of every row in one record."""
    return scored.select(key, "score", "prediction", "recommended_label", breakdown_map().alias("breakdown"))


def modality_strength(features: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Mean magnitude per feature group."""
    rows = []
    for group, _, label, members in FEATURE_GROUPS:
        total = " + ".join(f"abs(cast({n} as double))" for n in members)
        rows.append(
            f"named_struct('group', \"{group}\", 'label', \"{label}\", "
            f"'strength', ({total}) / {len(members)}D)"
        )
    return features.select(key, F.expr(f"inline(array({', '.join(rows)}))"))


def modality_drivers(features: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """The strongest four features of each group."""
    labels = [f.name.replace("_", " ")[:LABEL_WIDTH] for f in FEATURES]
    return _unfold_groups(features, key, DRIVERS_PER_GROUP).select(
        key,
        _lookup(GROUP_OF).alias("modality"),
        "rank",
        _lookup(labels).alias("feature"),
        F.col("value").alias("impact"),
    )


def display_rule(feature: Feature) -> tuple[str, float]:
    """How a feature is brought to a 0-1 scale: signed, size or soft, and its divisor."""
    for part, scale in DISPLAY_SCALES:
        if part in feature.name:
            return "signed", scale
    if feature.modality == "survey":
        return "signed", 1.0 if any(part in feature.name for part in UNIT_SURVEY_PARTS) else 5.0
    return ("size", 1.0) if feature.modality == "img" else ("soft", 10.0)


def display_strength() -> Column:
    """Strength of (position, value); a soft value up to 1 counts as it is."""
    rules = [display_rule(f) for f in FEATURES]
    kind, scale = _lookup([k for k, _ in rules]), _lookup([s for _, s in rules])
    value, size = F.col("value"), F.abs(F.col("value"))
    scaled = (
        F.when(kind == "signed", value / scale)
        .when((kind == "soft") & (size > 1.0), size / scale)
        .otherwise(size)
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), scaled))


def feature_matrix(features: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Feature x modality grid of the six strongest features of each modality.

    Short labels are unique over all modalities, so a grid row has exactly one filled cell
    and the pivot needs no grouping.
    """
    tops = _per_group(MATRIX_PER_MODALITY)
    tops["img"] = f"filter({tops['img']}, s -> img_has_image > 0)"
    long = features.select(key, F.expr(f"inline(concat({', '.join(tops.values())}))"))
    cells = long.select(
        key,
        _lookup([f.short_label for f in FEATURES]).alias("feature"),
        _lookup([f.modality for f in FEATURES]).alias("modality"),
        display_strength().alias("strength"),
    ).where(F.col("strength") > FAINT)
    return cells.select(
        key,
        "feature",
        *[F.when(F.col("modality") == m, F.col("strength")).alias(m) for m in tops],
    )


def image_profile(features: DataFrame, key: str = "image_id") -> DataFrame:
    """Ten image descriptors relative to the largest one."""
    names = [n for n in IMAGE_FEATURES if n != "img_has_image"]
    largest = F.greatest(*names)
    scale = F.when(largest == 0, F.lit(1.0)).otherwise(largest)
    return features.where(F.col("img_has_image") > 0).select(
        key,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n.removeprefix("img_")).alias("descriptor"),
                        (F.col(n) / scale).alias("relative"),
                    )
                    for n in names
                ]
            )
        ),
    )
