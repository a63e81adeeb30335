"""Multi-label classification of texts on the axes of an attack ontology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.literals import guarded
from ..functions.patterns import GOALS, RETRIEVED, TECHNIQUES, VECTORS, portable

# Labels of the nodes.
TECHNIQUE_LABELS = {
    "TQ-01": "Context Ignoring", "TQ-02": "Payload Splitting", "TQ-03": "Obfuscation", "TQ-04": "Roleplay", "TQ-05": "Refusal Suppression", "TQ-06": "Few-Shot Priming", "TQ-07": "Completion Compliance",
    "TQ-08": "Distractor", "TQ-09": "Authority Spoofing", "TQ-10": "Tool-Call Injection", "TQ-11": "Memory Poisoning", "TQ-12": "Goal Hijacking", "TQ-13": "CoT Manipulation", "TQ-14": "Trust-Boundary Escalation",
}
#: Node, OWASP LLM01, MITRE ATLAS, HackAPrompt; a node without any is an extension, and so are those in EXTENSIONS.
CROSSWALK = [
    ("IT-01", "LLM01 — Direct", "AML.T0051.000", "(all techniques)"), ("IT-02", "LLM01 — Indirect", "AML.T0051.001", None), ("IT-03", "LLM01 (extended)", "AML.T0051.001 (extended)", None),
    ("DV-01", "LLM01", "AML.T0051.000", "All techniques"), ("DV-02", "LLM01 — Indirect", "AML.T0051.001", None), ("DV-03", "LLM01 — Indirect (implied)", "AML.T0051.001", None), ("DV-04", "LLM01 (extended)", "AML.T0051.001 (extended)", None), ("DV-05", "LLM01 (extended)", None, None),
    ("DV-06", "LLM01 — Indirect", "AML.T0051.001", None), ("DV-07", "LLM01 — Indirect (implied)", "AML.T0051.001", None), ("DV-08", None, None, None), ("DV-09", "LLM01", "AML.T0051", "Authority framing"), ("DV-10", None, "AML.T0043 (Craft Adversarial Data)", None),
    ("TQ-01", "LLM01", "AML.T0051", "CI"), ("TQ-02", "LLM01", "AML.T0051", "PS"), ("TQ-03", "LLM01", "AML.T0043 (partial)", "OB"), ("TQ-04", "LLM01", "AML.T0054 (Jailbreak)", "RP + PT"), ("TQ-05", "LLM01", "AML.T0054 (partial)", "RS"), ("TQ-06", "LLM01", "AML.T0043 (partial)", "FS"), ("TQ-07", "LLM01", None, "CC"),
    ("TQ-08", "LLM01", None, "DI"), ("TQ-09", "LLM01", "AML.T0051", None), ("TQ-10", "LLM01 (extended)", "AML.T0051.001 (extended)", None), ("TQ-11", "LLM01 (extended)", None, None), ("TQ-12", "LLM01 (extended)", None, None), ("TQ-13", None, None, None), ("TQ-14", None, "AML.T0040 (extended)", None),
    ("GL-01", "LLM01", "AML.T0051 / AML.T0037", None), ("GL-02", "LLM01", "AML.T0051", None), ("GL-03", "LLM01", "AML.T0040", None), ("GL-04", "LLM01", "AML.T0054 (Jailbreak)", None), ("GL-05", "LLM01", "AML.T0048 (Societal Harm)", None), ("GL-06", None, None, None), ("GL-07", None, None, None),
    ("GL-08", "LLM01 (implied)", "AML.T0048 (partial)", None), ("GL-09", None, "AML.T0043 (extended)", None),
]
EXTENSIONS = ["IT-03", "DV-04", "DV-05", "DV-06", "DV-07", "DV-08", "DV-10", "TQ-10", "TQ-11", "TQ-12", "TQ-13", "TQ-14", "GL-06", "GL-07", "GL-09"]
# End of fixed values.


def classify(texts: DataFrame, id_column: str, text_column: str = "text") -> DataFrame:
    """injection_type, delivery_vector, technique and goal arrays; matching is case-sensitive on lower-cased text.

    Lower case is taken once a row and every pattern is tried once, and only where
    one of its literals stands: matches are columns of their own before arrays are
    made of them.
    """
    low = texts.select(F.col(id_column), F.lower(F.coalesce(F.col(text_column), F.lit(""))).alias("low_"))
    packs = {"IT-02": [RETRIEVED], **{k: [p] for k, p in VECTORS.items()}, **TECHNIQUES, **GOALS}
    hits = low.select(id_column, *[guarded(F.col("low_"), ps, lambda p: F.col("low_").rlike(portable(p))).alias(k) for k, ps in packs.items()])
    named = lambda ids, *first: F.filter(F.array(*first, *[F.when(F.col(f"`{k}`"), F.lit(k)) for k in ids]), lambda x: x.isNotNull())
    known = lambda ids: F.transform(F.array(named(ids)), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit("UNKNOWN"))))[0]
    return hits.select(
        id_column, F.array(F.when(F.col("`IT-02`"), "IT-02").otherwise("IT-01")).alias("injection_type"), named(VECTORS, F.lit("DV-01")).alias("delivery_vector"), known(TECHNIQUES).alias("technique"), known(GOALS).alias("goal"),
    )


def distribution(classified: DataFrame) -> DataFrame:
    """Count and share of every node on every axis, in one pass over the texts.

    Axes are a handful of nodes, so partial counts are tiny before the shuffle.
    """
    names = ["injection_type", "delivery_vector", "technique", "goal"]
    nodes = lambda axis: F.transform(axis, lambda v: F.struct(F.lit(axis).alias("axis"), v.alias("node")))
    pairs = F.concat(*map(nodes, names), F.array(F.struct(F.lit("total").alias("axis"), F.lit("all").alias("node"))))
    # an inner explode would have the planner build the array a second time, to see whether it is empty
    counts = classified.select(F.explode_outer(pairs).alias("p")).groupBy("p.axis", "p.node").agg(F.count("*").alias("n"))
    total = counts.where("axis = 'total'").select(F.col("n").alias("total"))
    return counts.where("axis <> 'total'").join(F.broadcast(total)).select("axis", "node", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def rates(classified: DataFrame) -> DataFrame:
    known = ~F.array_contains("technique", "UNKNOWN")
    return classified.agg(F.count("*").alias("n"), F.count_if((F.size("technique") > 1) & known).alias("multi_technique"), F.count_if(~known).alias("no_technique"))


def labelled(counts: DataFrame, labels: dict[str, str] = TECHNIQUE_LABELS) -> DataFrame:
    """Counts with the label of each node; an unknown id is its own label."""
    dim = counts.sparkSession.createDataFrame(list(labels.items()), "node string, label string")
    return counts.join(F.broadcast(dim), "node", "left").withColumn("label", F.coalesce("label", "node"))  # a fixed dimension


def crosswalk(counts: DataFrame) -> DataFrame:
    """Counts by node with the node's ids in other frameworks, null where it has none there, and whether it is an extension of them."""
    dim = counts.sparkSession.createDataFrame(CROSSWALK, "node string, owasp string, atlas string, hackaprompt string")
    return counts.join(F.broadcast(dim), "node", "left").withColumn("is_new", F.col("node").isin(EXTENSIONS))  # a fixed dimension


def most_common(rows: DataFrame, values: str, order: str, k: int) -> DataFrame:
    """(node, n): the k most frequent elements of an array column; ties go to the one that comes first, by row and place in the array."""
    each = rows.select(order, F.posexplode(values).alias("at", "node"))
    counts = each.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(k).drop("first")
