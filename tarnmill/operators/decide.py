"""Decision rules on wide predictions: clusters, plans, biomarker maps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnmill.operators.metrics import clip


def cluster(c=F.col) -> Column:
    """The first cluster whose condition holds. Thresholds and their order."""
    trauma = (c("acl") >= 0.45) & ((c("mcl") >= 0.40) | (c("medial_meniscus") >= 0.45) | (c("lateral_meniscus") >= 0.45)) & ((c("contusion") >= 0.35) | (c("effusion") >= 0.60))
    return (
        F.when(trauma, "multi_ligament_trauma").when(c("acl") >= 0.50, "acl_rupture")
        .when((c("medial_oa") >= 0.50) | (c("lateral_oa") >= 0.50) | (c("pf_oa") >= 0.50), "osteoarthritis")
        .when((c("medial_meniscus") >= 0.50) | (c("lateral_meniscus") >= 0.50), "meniscal_tear")
        .when((c("effusion") >= 0.65) | (c("synovitis") >= 0.50) | (c("bakers") >= 0.50), "effusion_synovitis")
        .when((c("contusion") >= 0.50) | (c("fracture") >= 0.40), "contusion_fracture").otherwise("normal_reference")
    )


@dataclass(frozen=True)
class CatalogEntry:
    """What a finding calls for: its product, tier (the larger the more invasive) and kit."""

    finding: str
    product: str
    tier: int
    kit: tuple[str, ...]


#: A neutral catalog; users bring their own table of the same shape.
CATALOG = (
    CatalogEntry("acl", "ligament fixation", 5, ("tunnel guide", "graft board", "suspension button")),
    CatalogEntry("mcl", "suture anchor", 5, ("anchor driver", "suspension button")),
    CatalogEntry("medial_meniscus", "meniscal repair", 3, ("repair needle", "probe")),
    CatalogEntry("lateral_meniscus", "meniscal repair", 3, ("repair needle", "probe")),
    CatalogEntry("medial_oa", "partial arthroplasty", 6, ("robot tray", "trial inserts")),
    CatalogEntry("lateral_oa", "partial arthroplasty", 6, ("robot tray", "trial inserts")),
    CatalogEntry("pf_oa", "patellofemoral implant", 6, ("robot tray", "patella clamp")),
    CatalogEntry("effusion", "fluid management", 2, ("pump tubing",)),
    CatalogEntry("synovitis", "shaver", 2, ("shaver blade", "pump tubing")),
    CatalogEntry("bakers", "shaver", 2, ("shaver blade", "ablation wand")),
    CatalogEntry("contusion", "bone graft", 4, ("delivery cannula",)),
    CatalogEntry("fracture", "plate", 7, ("plate set", "screw set")),
)
#: Patterns of findings that call for a joint plan: name, condition.
SYNERGIES = {
    "multi_ligament": lambda f: f("acl") & f("mcl"),
    "acl_meniscus": lambda f: f("acl") & (f("medial_meniscus") | f("lateral_meniscus")),
    "oa_contusion": lambda f: (f("medial_oa") | f("lateral_oa") | f("pf_oa")) & f("contusion"),
    "inflammatory": lambda f: (f("effusion") & f("synovitis")) | f("bakers"),
    "fracture_haemarthrosis": lambda f: f("fracture") & (f("effusion") | f("contusion")),
}


def recommend(wide: DataFrame, threshold: float = 0.5, catalog=CATALOG) -> DataFrame:
    """(study, n_findings, products, kit, top_tier, synergies) per row, without a shuffle.

    The catalog, of fixed size, is an array in the plan; entries are ordered by tier, then by the order of the
    targets, which settles ties. The kit keeps the first occurrence of each item.
    """
    entries = sorted(catalog, key=lambda e: -e.tier)  # stable: ties keep the order of the targets
    active = F.filter(
        F.array(*[
            F.when(F.col(e.finding) >= threshold, F.struct(F.lit(e.product).alias("product"), F.lit(e.tier).alias("tier"), F.array(*map(F.lit, e.kit)).alias("kit"))) for e in entries
        ]),
        lambda x: x.isNotNull(),
    )
    positive = lambda t: F.coalesce(F.col(t) >= threshold, F.lit(False))
    synergies = F.filter(F.array(*[F.when(rule(positive), F.lit(name)) for name, rule in SYNERGIES.items()]), lambda x: x.isNotNull())
    out = wide.select("study", active.alias("a"), synergies.alias("synergies"))
    return out.select(
        "study", F.size("a").cast("bigint").alias("n_findings"), F.array_join(F.transform("a", lambda x: x["product"]), ",").alias("products"),
        F.array_join(F.array_distinct(F.flatten(F.transform("a", lambda x: x["kit"]))), ",").alias("kit"),
        F.coalesce(F.array_max(F.transform("a", lambda x: x["tier"])), F.lit(1)).cast("bigint").alias("top_tier"), F.array_join("synergies", ",").alias("synergies"),
    )


def biomarker_probs(columns: dict[str, tuple[str, float, float]]) -> list[Column]:
    """Clipped linear maps: name -> (measure, slope, intercept)."""
    return [clip(slope * F.col(m) + intercept, 0.02, 0.98).alias(name) for name, (m, slope, intercept) in columns.items()]


def likeliest(names: list[str]) -> Column:
    """The name of the column with the largest value, the first of equals; null where all are null."""
    pairs = F.filter(F.array(*[F.struct(F.col(n).alias("p"), F.lit(-k).alias("k"), F.lit(n).alias("name")) for k, n in enumerate(names)]), lambda x: x["p"].isNotNull())
    return F.array_max(pairs)["name"]
