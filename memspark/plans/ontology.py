"""The default ontology: which relations there are, and which types their ends may have. A caller may pass another table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Types of entities, and for each relation the types of its source and of its target.
ENTITY_TYPES = ["Project", "Tool", "Concept", "Document", "Decision", "Meeting", "Email", "Issue", "Action", "Task", "Person", "Rationale"]
_THINGS = ["Project", "Tool", "Concept", "Document", "Meeting", "Email", "Issue", "Action", "Task", "Rationale"]
RELATIONS = [
    ("USES", ["Project", "Decision", "Tool", "Concept"], ["Tool", "Project", "Concept"]),
    ("ADOPTS", ["Project", "Decision", "Concept"], ["Tool", "Project", "Concept"]),
    ("SELECTS", ["Project", "Decision", "Concept"], ["Tool", "Project", "Concept"]),
    ("HAS_LAYER", ["Project", "Concept"], ["Concept"]),
    ("STORES", ["Concept"], ["Concept"]),
    ("EXTRACTS", ["Concept"], ["Concept"]),
    ("PRODUCES", ["Concept"], ["Concept"]),
    ("EXPORTS", ["Concept"], ["Concept"]),
    ("EXPORTS_TO", ["Concept"], ["Tool", "Concept"]),
    ("CONNECTS_TO", ["Tool", "Concept"], ["Concept"]),
    ("VALIDATES", ["Concept"], ["Concept"]),
    ("SELECTS_MODEL_BY", ["Concept"], ["Concept"]),
    ("STATUS", ["Decision", "Concept"], ["Concept"]),
    ("ROLE", ["Tool", "Concept"], ["Concept"]),
    ("REQUIRES", ["Project", "Concept"], ["Concept"]),
    ("CALLS", ["Project", "Concept"], ["Concept"]),
    ("HAS_RATIONALE", ["Decision", "Concept"], ["Rationale"]),
    ("SUPPORTED_BY", ["Rationale"], ["Document", "Concept"]),
    ("CAUSED_BY", ["Rationale"], ["Concept"]),
    ("ADDRESSES", ["Rationale"], ["Issue", "Concept"]),
    ("MADE_IN", ["Decision"], ["Project"]),
    ("RELATED_TO", _THINGS, _THINGS),
    ("SUPERSEDES", ["Decision", "Concept"], ["Decision", "Concept"]),
    ("MENTIONS", ["Document", "Meeting", "Email"], ["Person", "Project", "Tool", "Concept", "Decision", "Issue", "Action", "Task"]),
]


def default_ontology(spark: SparkSession) -> DataFrame:
    """relation, domain, range."""
    return spark.createDataFrame(RELATIONS, "relation string, domain array<string>, range array<string>")


def dump_yaml(ontology: DataFrame) -> str:
    """The ontology as YAML: entity types and relations with domain and range, in the order of their names. An ontology is a rule table of a few dozen rows."""
    lines = ["entity_types:", *[f"  - {t}" for t in ENTITY_TYPES], "relations:"]
    for r in ontology.orderBy("relation").collect():
        lines += [f"  {r['relation']}:", f"    domain: [{', '.join(sorted(r['domain']))}]", f"    range: [{', '.join(sorted(r['range']))}]"]
    return "\n".join(lines) + "\n"
