"""Decision samples from JSON objects whose fields go by several names: the first name that has a value wins, and is read by its type.

What can't be read is replaced by the field's default and told in rejects, one entry a field: ``name:type`` for a value of
another JSON type, ``name:value`` for a word or number that the field may not hold. A payload that is no JSON object is
rejected as a whole (``payload``) and all fields have their defaults. JSON null is no value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions.kernel import clamp_score

# By field, its names in order of preference, the words it may hold, and the default.
WORDS = {
    "observed_decision": (("observed_decision", "final_decision"), ("ALLOW", "BLOCK", "WATCH"), "WATCH"),
    "observed_regime": (("observed_regime", "regime"), ("STABLE", "VOLATILE", "TRANSITION"), "TRANSITION"),
    "observed_horizon": (("observed_horizon", "horizon"), ("24H", "7D", "14D", "30D", "default"), "7D"),
    "observed_reliability": (("reliability", "sample_reliability", "observed_reliability"), ("high", "medium", "low", "none"), "none"),
    "dominance_state": (("dominance_state", "mci_dominance_state"), ("recovery_dominant", "rupture_dominant", "balanced", "RECOVERY", "RUPTURE", "NEUTRAL"), "unknown"),
    "neutralization_reason": (("neutralization_reason",), ("insufficient_data", "contradictory_structure", "unstable_distribution", "excessive_decay", "excessive_rupture", "invalid_temporal_alignment", "low_confidence", "degraded_snapshot", "corrupted_distribution", "none"), "none"),
    "neutralization_severity": (("neutralization_severity",), ("low", "medium", "high", "critical", "none"), "none"),
    "rupture_evolution_state": (("rupture_evolution_state",), ("improving", "stable", "worsening", "explosive", "unknown"), "unknown"),
}
# Words of an older scheme.
OLD_WORDS = {"RECOVERY": "recovery_dominant", "RUPTURE": "rupture_dominant", "NEUTRAL": "balanced"}
TEXTS = {"observed_analytical_version": ("observed_analytical_version", "analytical_version"), "observed_reason": ("observed_reason", "mci_decision_reason", "decision_reason")}
SCORES = {
    "mci_decision_score": ("mci_decision_score", "decision_score"), "mci_allow_raw_score": ("mci_allow_raw_score", "allow_raw_score"), "mci_block_raw_score": ("mci_block_raw_score", "block_raw_score"),
    "mci_decision_support_probability": ("mci_decision_support_probability", "decision_support_probability"), "mci_risk_rupture_probability": ("mci_risk_rupture_probability", "risk_rupture_probability"), "confidence_score": ("confidence_score", "confidence"),
}


def _first(names: tuple[str, ...]) -> Column:
    """The value of the first of the names that has one."""
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in (F.variant_get("v", f"$.{n}", "variant") for n in names)])


def normalised(rows: DataFrame, payload: str) -> DataFrame:
    """rows with the fields of WORDS, TEXTS and SCORES in place of the JSON object in ``payload``, and rejects."""
    x = rows.withColumn("v", F.try_parse_json(payload))
    x = x.withColumn("v", F.when(F.schema_of_variant("v").startswith("OBJECT"), F.col("v")))
    fields = {k: names for k, (names, *_) in WORDS.items()} | TEXTS | SCORES
    x = x.withColumns({f"raw_{k}": _first(names) for k, names in fields.items()})
    kind = lambda k: F.schema_of_variant(f"raw_{k}")
    is_text = {k: kind(k) == "STRING" for k in (*WORDS, *TEXTS)}
    is_number = {k: kind(k).isin("BIGINT", "DOUBLE", "FLOAT") | kind(k).startswith("DECIMAL") for k in SCORES}
    text = lambda k: F.when(is_text[k], F.try_variant_get(f"raw_{k}", "$", "string"))
    number = {k: F.when(is_number[k], F.try_variant_get(f"raw_{k}", "$", "double")) for k in SCORES}
    out: dict[str, Column] = {}
    reasons: list[Column] = [F.when(F.col("v").isNull(), "payload")]
    for k, (_, words, default) in WORDS.items():
        held = F.when(text(k).isin(*words), text(k))
        for old, new in OLD_WORDS.items() if k == "dominance_state" else ():
            held = F.when(held == old, new).otherwise(held)
        out[k] = F.coalesce(held, F.lit(default))
        reasons.append(F.when(~is_text[k], f"{k}:type").when(~text(k).isin(*words), f"{k}:value"))
    for k in TEXTS:
        trimmed = F.trim(text(k))
        out[k] = F.when(trimmed != "", trimmed).otherwise("unknown")
        reasons.append(F.when(~is_text[k], f"{k}:type").when(trimmed == "", f"{k}:value"))
    for k in SCORES:
        out[k] = clamp_score(number[k])
        reasons.append(F.when(~is_number[k], f"{k}:type").when((number[k] < 0) | (number[k] > 100), f"{k}:value"))
    own = [c for c in rows.columns if c != payload]
    return x.select(*own, *[c.alias(k) for k, c in out.items()], F.array_compact(F.array(*reasons)).alias("rejects"))
