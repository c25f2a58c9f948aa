"""Query understanding: lexical variants, rule expansion, enumeration cues, documents that a question names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens

# What a question asks for, as words or phrases between characters that are no letters, digits or _.
CUES = {
    "quantifier": "all|every|each|any|both",
    "enumeration verb": "list|enumerate|itemi[sz]e|outline|summari[sz]e|overview|describe",
    "completeness adjective": "complete|entire|full|whole|comprehensive|exhaustive",
    "set-seeking interrogative": "what are|which|how many|what kinds?|what types?",
}
FACT = "what is the|when is|when does|when must|how much|who|where"

# Of each rule, the substrings that trigger it and the sub-queries that it adds.
RULES = [
    (
        ["eligib"],
        [
            "criteria requirements inclusion exclusion patient population",
            "who qualifies conditions that must be met to participate",
        ],
    ),
    (
        ["require", "must", "mandatory", "obligat"],
        [
            "mandatory obligations regulatory requirement shall must",
            "what is required by regulation or guidance document",
        ],
    ),
    (
        ["when ", "timing", "deadline", "how soon", "within"],
        [
            "timing sequence order of events timeline milestones",
            "conditions that trigger this action deadline",
        ],
    ),
    (
        ["difference between", "differ", "vs ", "versus", "compared to", "contrast"],
        [
            "comparison contrast distinction how does X differ from Y",
            "similarities and differences between two approaches or programmes",
        ],
    ),
    (
        ["defin", "what is", "what are", "meaning of"],
        [
            "definition meaning how is this concept defined in the guidance",
            "scope and purpose of this term or programme",
        ],
    ),
    (
        ["process", "procedure", "how to", "steps", "workflow"],
        [
            "step-by-step procedure workflow how to submit or implement",
            "timeline sequence submission process regulatory pathway",
        ],
    ),
    (
        ["exception", "special case", "unless", "except", "not required", "waive"],
        [
            "exception to the general rule special circumstance edge case",
            "circumstances where standard rules or requirements do not apply",
        ],
    ),
    (
        ["inform", "consent", "disclosure", "patient information"],
        [
            "informed consent disclosure requirements regulatory obligations",
            "patient information risks benefits alternative treatments",
        ],
    ),
    (
        ["safety", "adverse", "toxicity", "risk", "harm"],
        [
            "safety monitoring adverse event reporting toxicity risk management",
            "sponsor obligations for subject safety in clinical trials",
        ],
    ),
    (
        ["submit", "submission", "application", "filing", "dossier"],
        [
            "submission requirements application content format regulatory filing",
            "what must be included in the submission or application",
        ],
    ),
    (
        ["approv", "approval", "marketing authorisation", "nda", "bla"],
        [
            "marketing application approval regulatory pathway NDA BLA",
            "conditions for approval review process decision",
        ],
    ),
    (
        ["monitor", "committee", "oversight", "review board", "irb"],
        [
            "independent oversight committee monitoring responsibilities",
            "IRB review board safety monitoring committee obligations",
        ],
    ),
    (
        ["dose", "dosing", "dosage", "exposure", "pharmacokinetic", "pk"],
        [
            "dose selection dosage optimisation pharmacokinetics exposure",
            "recommended phase 2 dose dose-limiting toxicity dose adjustment",
        ],
    ),
    (
        ["biomarker", "diagnostic", "ivd", "companion", "assay"],
        [
            "biomarker IVD companion diagnostic analytical validation",
            "patient selection biomarker-defined population assay performance",
        ],
    ),
    (
        ["pediatric", "paediatric", "adolescent", "child", "minor"],
        [
            "paediatric adolescent patient inclusion criteria dose adjustment",
            "age-appropriate dosing safety monitoring younger patients",
        ],
    ),
    (
        ["protocol", "amendment", "ind", "investigational new drug"],
        [
            "protocol amendment IND submission content format requirements",
            "changes to protocol sponsor notification FDA communication",
        ],
    ),
    (
        ["cohort", "expansion", "phase 1", "first-in-human", "fih"],
        [
            "expansion cohort FIH trial design objectives safety monitoring",
            "multiple cohort trial dose escalation subject population",
        ],
    ),
]


def asks(text: Column, phrases: str) -> Column:
    """Whether one of the phrases stands in the lower-case text, between characters that are no ASCII letters, digits or _."""
    return F.lower(text).rlike(f"(^|[^a-z0-9_])({phrases})([^a-z0-9_]|$)")


def lexical_variants(questions: DataFrame, q_id: str, text: str = "text") -> DataFrame:
    """Rows (q_id, variant_no, variant): all tokens, the last four, the first six distinct; none that is blank or the question itself."""
    t = F.col("_t")
    forms = F.array(F.array_join(t, " "), F.array_join(F.slice(t, F.greatest(F.size(t) - 3, F.lit(1)), F.lit(4)), " "), F.array_join(F.slice(F.array_distinct(t), 1, 6), " "))
    x = questions.select(q_id, F.col(text).alias("_q"), tokens(F.col(text)).alias("_t")).select(q_id, "_q", F.posexplode(forms).alias("p", "variant"))
    return x.where((F.col("variant") != "") & (F.lower("variant") != F.lower("_q"))).select(q_id, (F.col("p") + 1).cast("long").alias("variant_no"), "variant")


def ordered_expansion(questions: DataFrame, variants: DataFrame, q_id: str, text: str = "text") -> DataFrame:
    """Rows (q_id, pos, sub_query): the question, then its variants, each text once at its first place."""
    all_ = questions.select(q_id, F.lit(0).cast("long").alias("n"), F.trim(text).alias("sub_query")).unionByName(variants.select(q_id, F.col("variant_no").alias("n"), F.col("variant").alias("sub_query")))
    first = all_.where("sub_query <> ''").groupBy(q_id, "sub_query").agg(F.min("n").alias("n"))
    return first.select(q_id, F.row_number().over(Window.partitionBy(q_id).orderBy("n")).cast("long").alias("pos"), "sub_query")


def rule_expansion(questions: DataFrame, q_id: str, text: str = "text") -> DataFrame:
    """Rows (q_id, rule_no, sub_query) of the rules that have a trigger anywhere in the lower-case question."""
    rules = F.array(*[F.struct(F.lit(i + 1).cast("long").alias("no"), F.array(*map(F.lit, t)).alias("on"), F.array(*map(F.lit, s)).alias("add")) for i, (t, s) in enumerate(RULES)])
    x = questions.select(q_id, F.lower(text).alias("_q"), F.explode(rules).alias("r")).where(F.exists("r.on", lambda t: F.contains(F.col("_q"), t)))
    return x.select(q_id, F.col("r.no").alias("rule_no"), F.explode("r.add").alias("sub_query"))


def enumeration_cues(questions: DataFrame, text: str = "text") -> DataFrame:
    """Add cues, wants_set and cue_score: a set is asked for by a cue, or by two where the form asks for one fact."""
    t, q = F.col("_t"), F.col(text)
    plural = F.exists(F.slice(t, F.greatest(F.size(t) - 2, F.lit(1)), F.lit(3)), lambda w: (F.length(w) > 3) & w.endswith("s")) | F.array_contains(t, "criteria")
    cues = [F.when(asks(q, p), name) for name, p in CUES.items()] + [F.when(plural, "plural head noun")]
    x = questions.withColumn("_t", tokens(q)).withColumn("_c", F.array_compact(F.array(*cues))).withColumn("_fact", asks(q, FACT) & ~F.array_contains("_c", "quantifier"))
    n = F.size("_c")
    x = x.withColumn("cues", F.concat_ws(",", F.array_join("_c", ","), F.when(F.col("_fact"), "-specific fact form"))).withColumn("cues", F.regexp_replace("cues", "^,", ""))
    return x.withColumn("wants_set", (n > 0) & (~F.col("_fact") | (n >= 2))).withColumn("cue_score", F.round(F.least(F.lit(1.0), n / 3), 2)).drop("_t", "_c", "_fact")


def _begin(text: Column) -> Column:
    """The first 16, 8, 4, 2 or 1 characters, as many of these as there are."""
    sizes = [F.when(F.length(text) >= n, F.substring(text, 1, n)) for n in _PARTS[::-1]]
    return F.coalesce(*sizes, text)


def _parts(text: Column) -> Column:
    """Each distinct string that _begin gives for some string in the text."""
    at = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))
    return F.array_distinct(F.concat(F.array(F.lit("")), *[F.coalesce(at(n), F.array().cast("array<string>")) for n in _PARTS]))


_PARTS = (1, 2, 4, 8, 16)


def document_matches(questions: DataFrame, registry: DataFrame, q_id: str) -> DataFrame:
    """Rows (q_id, n_matches, resolved) of every question: the document of that id, else those whose label, or base name if the registry has one, holds the text.

    ``resolved`` is the one label that matches; several or none leave the search over all documents. Each distinct text
    meets the ids by equality, and the labels by its beginning, which stands somewhere in any label that holds it.
    """
    q = questions.select(q_id, F.lower(F.trim("text")).alias("_q"))
    asked = q.where("_q is not null").select("_q").distinct()
    named = registry.select(F.lower("reg_id").alias("_q"), "label").join(asked, "_q").groupBy("_q").agg(F.max("label").alias("named"))
    names = F.array("label", *(["base_name"] if "base_name" in registry.columns else []))
    labels = registry.where("label is not null").select("label", F.explode(names).alias("_l")).where("_l is not null").select("label", F.lower("_l").alias("_l")).distinct()
    labels = labels.select("label", "_l", F.explode(_parts(F.col("_l"))).alias("_part"))
    hits = labels.join(asked.withColumn("_part", _begin(F.col("_q"))), "_part").where(F.contains(F.col("_l"), F.col("_q")))
    found = hits.groupBy("_q").agg(F.countDistinct("label").alias("n"), F.min("label").alias("one"))
    x = q.join(named, "_q", "left").join(found, "_q", "left")
    n = F.when(F.col("named").isNotNull(), 1).otherwise(F.coalesce("n", F.lit(0))).cast("long")
    return x.select(q_id, n.alias("n_matches"), F.coalesce("named", F.when(F.col("n") == 1, F.col("one"))).alias("resolved"))
