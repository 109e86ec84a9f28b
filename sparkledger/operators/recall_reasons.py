"""The frozen first taxonomy of recall reasons and its rule labels, as data for the operators of `taxonomy`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkledger.operators.taxonomy import NODE, Rule, rule_labels

# fixed values: node id, parent, label and examples of the 24 nodes
NODES = (
    ("quality_and_potency", None, "Quality and potency", ("Subpotent Drug", "Failed Dissolution Specifications", "Failed Impurities/Degradation Specifications")),
    ("manufacturing_controls", None, "Manufacturing controls", ("cGMP Deviations", "Lack of Processing Controls", "Cross Contamination with Other Products")),
    ("labeling_and_packaging", None, "Labeling and packaging", ("Labeling", "Defective Container", "Defective Delivery System")),
    ("regulatory_status", None, "Regulatory status", ("Marketed Without an Approved NDA/ANDA", "Marked without an Approved NDA/ANDA")),
    ("storage_distribution", None, "Storage and distribution", ("Temperature Abuse",)),
    ("other", None, "Other", ()),
    ("sterility_assurance", "quality_and_potency", "Sterility assurance", ("Lack of Assurance of Sterility", "Lack of Sterility Assurance", "Non-Sterility")),
    ("microbial_contamination", "quality_and_potency", "Microbial contamination", ("Microbial Contamination of Non-Sterile Products",)),
    ("particulate_or_foreign_matter", "quality_and_potency", "Particulate or foreign matter", ("Presence of Particulate Matter", "Presence of Foreign Substance", "Presence of Foreign Tablets/Capsules")),
    ("impurities_or_degradation", "quality_and_potency", "Impurities or degradation", ("Failed Impurities/Degradation Specifications", "Chemical Contamination")),
    ("potency_or_content", "quality_and_potency", "Potency or content", ("Subpotent Drug", "Superpotent Drug", "Failed Content Uniformity Specifications")),
    ("dissolution_or_tablet_specs", "quality_and_potency", "Dissolution or tablet specifications", ("Failed Dissolution Specifications", "Failed Tablet/Capsule Specifications", "Crystallization")),
    ("stability_or_expiry", "quality_and_potency", "Stability or expiry", ("Stability Data Does Not Support Expiry", "Failed Stability Specifications")),
    ("appearance_or_physical_defect", "quality_and_potency", "Appearance or physical defect", ("Discoloration",)),
    ("formulation_or_ingredient_error", "quality_and_potency", "Formulation or ingredient error", ("Incorrect/Undeclared Excipients", "Product was manufactured with Potassium Chloride instead of Potassium Phosphate")),
    ("other_specification_failure", "quality_and_potency", "Other specification failure", ("Out-of-Specification test results", "Failed Moisture Limits", "Does Not Meet Monograph")),
    ("cgmp_deviation", "manufacturing_controls", "cGMP deviation", ("cGMP Deviations", "cGMP Deviation", "GMP Deviations")),
    ("processing_controls", "manufacturing_controls", "Processing controls", ("Lack of Processing Controls",)),
    ("cross_contamination", "manufacturing_controls", "Cross contamination", ("Penicillin Cross Contamination", "Cross Contamination with Other Products")),
    ("labeling_error", "labeling_and_packaging", "Labeling error", ("Labeling",)),
    ("container_or_closure_defect", "labeling_and_packaging", "Container or closure defect", ("Defective Container",)),
    ("delivery_system_defect", "labeling_and_packaging", "Delivery system defect", ("Defective Delivery System",)),
    ("unapproved_drug", "regulatory_status", "Unapproved drug", ("Marketed Without an Approved NDA/ANDA",)),
    ("temperature_abuse", "storage_distribution", "Temperature abuse", ("Temperature Abuse",)),
)

# fixed values: node id, confidence and patterns (over normalised text) of the 18 rules
RULES = (
    Rule("sterility_assurance", 0.96, (r"\black of assurance (of )?sterility\b", r"\black of sterility assurance\b", r"\black of assurance sterility\b", r"\bnon-sterility\b", r"\bnon sterility\b")),
    Rule("microbial_contamination", 0.95, (r"\bmicrobial contamination\b", r"\bmicrobial contamination of non-sterile products\b", r"\bmicrobal contamination\b")),
    Rule("particulate_or_foreign_matter", 0.94, (r"\bpresence of particulate matter\b", r"\bparticulate matter\b", r"\bforeign substance\b", r"\bforeign tablets?/capsules?\b", r"\bforeign matter\b", r"\bglass (fragment|particle|particulate)", r"\bvisible particles?\b", r"\bembedded particles?\b", r"\bprecipitate\b")),
    Rule("impurities_or_degradation", 0.90, (r"\bimpurit(y|ies)\b", r"\bdegradation\b", r"\bchemical contamination\b", r"\bnitrosamine\b", r"\bndma\b")),
    Rule("potency_or_content", 0.92, (r"\bsubpotent\b", r"\bsub potent\b", r"\bsuperpotent\b", r"\bcontent uniformity\b", r"\bassay\b", r"\bpotency\b")),
    Rule("dissolution_or_tablet_specs", 0.90, (r"\bdissolution\b", r"\btablet/capsule specifications\b", r"\btablet specifications\b", r"\bcapsule specifications\b", r"\bcrystallization\b")),
    Rule("stability_or_expiry", 0.88, (r"\bstability data does not support exp?iry\b", r"\bfailed stability specifications\b", r"\bstability\b", r"\bexpir(y|ation)\b")),
    Rule("appearance_or_physical_defect", 0.86, (r"\bdiscoloration\b", r"\bcracked\b", r"\bvisible defect\b")),
    Rule("formulation_or_ingredient_error", 0.90, (r"\bincorrect/ ?undeclared excipients?\b", r"\bundeclared excipients?\b", r"\bincorrect solvent\b", r"\bwrong (active )?ingredient\b", r"\bmanufactured with .* instead of\b", r"\bincorrect grade of excipient\b", r"\bincorrect/ ?undeclared benzyl alcohol\b")),
    Rule("other_specification_failure", 0.84, (r"\bout[- ]of[- ]specification\b", r"\boos\b", r"\bfailed moisture limits\b", r"\bdoes not meet monograph\b", r"\bfailed excipient specifications\b", r"\bidentification testing\b")),
    Rule("cgmp_deviation", 0.92, (r"\bcgmp deviations?\b", r"\bcgmps deviations?\b", r"\bcgmp violations?\b", r"^cgmp:", r"\black of cgmp\b", r"\bgmp deviations?\b", r"\bgmp violations?\b", r"\bgood manufacturing practice\b", r"\bgood manufacturing practices deviations?\b")),
    Rule("processing_controls", 0.88, (r"\black of processing controls\b", r"\black of processing control\b", r"\bprocessing controls\b")),
    Rule("cross_contamination", 0.94, (r"\bpenicillin cross contamination\b", r"\bcross[- ]+contamination\b", r"\bcross contamination\b")),
    Rule("labeling_error", 0.90, (r"^labeling\b", r"\blabeling error\b", r"\bmislabel", r"\bmispack", r"\bpackaging defects?\b", r"\bincorrect label", r"\bwrong label")),
    Rule("container_or_closure_defect", 0.90, (r"\bdefective container\b", r"\bcontainer defect\b", r"\bclosure defect\b", r"\bdefective closure\b", r"\bcontainer/closure\b")),
    Rule("delivery_system_defect", 0.91, (r"\bdefective delivery system\b", r"\bdelivery system\b")),
    Rule("unapproved_drug", 0.96, (r"\bmarketed without an approved nda/anda\b", r"\bmarked without an approved nda/anda\b", r"\bmarketed without approved nda/anda\b", r"\bmarked without approved nda/anda\b", r"\bwithout an approved nda\b", r"\bwithout an approved anda\b", r"\black of drug listing\b", r"\bnot approved for sale\b", r"\bunapproved (new )?drug\b")),
    Rule("temperature_abuse", 0.93, (r"\btemperature abuse\b", r"\btemperature excursion\b")),
)


def frozen(spark: SparkSession, version: str = "v1") -> DataFrame:
    """The 24 nodes, 6 of them roots; definitions are in words of our own."""
    rows = [(version, n, p, label, f"Reasons of the kind {label.lower()}" + (f", such as {'; '.join(ex)}." if ex else "."), list(ex), 0 if p is None else 1, "active") for n, p, label, ex in NODES]
    return spark.createDataFrame(rows, NODE)


def unknown_nodes(taxonomy: DataFrame, version: str = "v1") -> list[str]:
    """Nodes that the rules need and that aren't active in the version; to be looked at before labels are written."""
    have = {r.node_id for r in taxonomy.where((F.col("version") == version) & (F.col("status") == "active")).select("node_id").distinct().collect()}
    return sorted({r.node_id for r in RULES} - have | ({"other"} - have))


def labels(records: DataFrame, text: str, key: str, other: bool = True, taxonomy: DataFrame | None = None, version: str = "v1") -> DataFrame:
    """Label rows of all rules that a reason satisfies; with `other`, reasons without any get that node at confidence 0."""
    return rule_labels(records, text, key, RULES, other, taxonomy, version)
