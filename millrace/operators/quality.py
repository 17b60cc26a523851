"""Quality, licence, rights and topic of a text, as Columns over fixed rule lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.extensions import EVALUATORS
from millrace.functions import text as T

# Licences that allow redistribution, and phrases that name a licence, first match first.
PERMISSIVE = ("CC-BY-4.0", "CC-BY-3.0", "CC-BY", "CC0-1.0", "CC0", "MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause")
LICENCES = (
    (r"creative\s+commons\s+attribution\s+4\.0\s+international", "CC-BY-4.0"),
    (r"creative\s+commons\s+attribution-noncommercial-sharealike", "CC-BY-NC-SA-4.0"),
    (r"creative\s+commons\s+attribution-sharealike", "CC-BY-SA-4.0"),
    (r"creative\s+commons\s+attribution-noncommercial", "CC-BY-NC-4.0"),
    (r"cc0\s+1\.0\s+universal|public\s+domain\s+dedication", "CC0-1.0"),
    (r"arxiv\.org\s+non-exclusive\s+license\s+to\s+distribute", "arXiv Non-exclusive License"),
    (r"mit\s+license", "MIT"),
    (r"apache\s+license,?\s+version\s+2\.0", "Apache-2.0"),
    (r"nptel\s+open\s+access|nptel.*?license", "NPTEL Open Access"),
)
# Licence names by rights class, in capitals.
VERIFIED = ("CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "NPTEL_EDUCATIONAL", "CC0", "CC0-1.0", "MIT", "APACHE-2.0", "PUBLIC_DOMAIN", "BSD-3-CLAUSE", "OPEN_DATA_COMMONS")
INTERNAL = ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "NPTEL_EDUCATIONAL", "ARXIV_NONCOMMERCIAL", "ACADEMIC_FREE_LICENSE", "PROPRIETARY_INTERNAL")
# Topic keywords, first group first.
TOPICS = (
    ("quantum_mechanics", r"\bquantum\b|\bwavefunction\b|\bschrod?inger\b|\bhamiltonian\b|\bqubit\b"),
    ("thermodynamics", r"\bthermodynamics?\b|\bentropy\b|\benthalpy\b|\bgibbs\b|\bcarnot\b|\bheat\s+engine\b"),
    ("astrophysics", r"\bastrophysics?\b|\bgalaxy\b|\bgalaxies\b|\bstar\b|\bblack\s+hole\b|\bneutron\s+star\b|\bexoplanet\b|\bcosmic\b"),
    ("electromagnetism", r"\belectromagnetism\b|\bmaxwell\b|\belectric\s+field\b|\bmagnetic\s+field\b|\bpoynting\b"),
    ("classical_mechanics", r"\bclassical\s+mechanics\b|\blagrangian\b|\bangular\s+momentum\b|\bnewtonian\b|\bpendulum\b"),
    ("relativity", r"\bgeneral\s+relativity\b|\bspecial\s+relativity\b|\blorentz\b|\bspacetime\b|\bmetric\s+tensor\b"),
    ("optics", r"\boptics\b|\bdiffraction\b|\brefraction\b|\binterferometer\b|\blaser\b"),
    ("geophysics", r"\bgeophysics\b|\bmantle\b|\bseismic\b|\blithosphere\b|\bmagma\b"),
)
FIELDS = (
    ("ai_ml", r"\b(neural\s+network|transformer|attention|deep\s+learning|llm)\b"),
    ("linux_systems", r"\b(linux|kernel|systemd|posix|bash)\b"),
    ("cybersecurity", r"\b(cipher|cryptography|vulnerability|exploit|rsa)\b"),
)


# Preprint categories (the first that a given one starts with counts) and the domain, topic and subtopic of each; those of the fields above.
CATEGORIES = (
    ("astro-ph", "science", "physics", "astrophysics"), ("astro-ph.co", "science", "physics", "cosmology"), ("astro-ph.ga", "science", "physics", "astrophysics"),
    ("astro-ph.he", "science", "physics", "high_energy_astrophysics"), ("astro-ph.sr", "science", "physics", "solar_stellar_astrophysics"), ("quant-ph", "science", "physics", "quantum_mechanics"),
    ("hep-th", "science", "physics", "high_energy_physics_theory"), ("hep-ph", "science", "physics", "particle_physics"), ("hep-ex", "science", "physics", "experimental_particle_physics"),
    ("gr-qc", "science", "physics", "general_relativity_gravitation"), ("cond-mat", "science", "physics", "condensed_matter"), ("nucl-th", "science", "physics", "nuclear_physics"),
    ("physics.optics", "science", "physics", "optics"), ("physics.flu-dyn", "science", "physics", "fluid_dynamics"), ("physics.chem-ph", "science", "physics", "chemical_physics"), ("physics.geo-ph", "science", "physics", "geophysics"),
    ("cs.AI", "ai_ml", "ml_fundamentals", "artificial_intelligence"), ("cs.LG", "ai_ml", "deep_learning", "machine_learning"), ("cs.CV", "ai_ml", "computer_vision", "vision_models"),
    ("cs.CL", "ai_ml", "nlp", "computational_linguistics"), ("stat.ML", "ai_ml", "ml_fundamentals", "statistical_learning"), ("math.PR", "mathematics", "probability_statistics", "probability"),
    ("math.ST", "mathematics", "probability_statistics", "statistics"), ("math.CA", "mathematics", "calculus", "classical_analysis"), ("math.DG", "mathematics", "geometry_trigonometry", "differential_geometry"),
    ("cs.CR", "cybersecurity", "cryptography", "security"), ("cs.SE", "software_engineering", "system_design", "software_engineering"), ("cs.NI", "networking", "osi_tcpip", "network_protocols"), ("cs.OS", "linux_systems", "kernel_internals", "operating_systems"),
)
FIELD_TOPICS = {"ai_ml": ("deep_learning", "neural_networks"), "linux_systems": ("kernel_internals", "os_engineering"), "cybersecurity": ("cryptography", "security")}


def classified(categories: Column, title: Column, text: Column) -> Column:
    """Struct (domain, topic, subtopic, confidence): by the first category that is known, else by keywords of title and text."""
    made = lambda d, t, s, c: F.struct(F.lit(d).alias("domain"), F.lit(t).alias("topic"), F.lit(s).alias("subtopic"), F.lit(c).alias("confidence"))

    def known(name: Column) -> Column:
        bare = F.lower(T.strip(name))
        out = None
        for prefix, *found in CATEGORIES:
            out = (F.when if out is None else out.when)(bare.startswith(prefix.lower()), made(*found, 0.95))
        return out

    def by_words(t: Column) -> Column:
        out = None
        for field, (topic_name, subtopic) in FIELD_TOPICS.items():
            out = (F.when if out is None else out.when)(t["domain"] == field, made(field, topic_name, subtopic, 0.85))
        return out.otherwise(F.struct(t["domain"].alias("domain"), F.lit("physics").alias("topic"), t["subtopic"].alias("subtopic"), t["confidence"].alias("confidence")))

    named = F.get(F.array_compact(F.transform(F.coalesce(categories, F.array().cast("array<string>")), known)), F.lit(0))
    return F.coalesce(named, T.let(topic(title, text), by_words))


def licence(text: Column, declared: Column, source: Column) -> Column:
    """Struct (name, known, internal_only): the declared licence, else the first phrase in the text, else the source's."""
    bare = T.strip(F.coalesce(declared, F.lit("")))
    name = F.when((bare != "") & (F.upper(bare) != "UNKNOWN"), bare)
    for pattern, found in LICENCES:
        name = name.when(text.rlike(f"(?i){pattern}"), found)
    origin = F.lower(F.coalesce(source, F.lit("")))
    name = name.when(origin.contains("nptel"), "CC-BY-NC-SA-4.0").when(origin.contains("arxiv"), "arXiv Non-exclusive License").otherwise("UNKNOWN")
    return T.let(name, lambda n: F.struct(n.alias("name"), (n != "UNKNOWN").alias("known"), (~n.isin(*PERMISSIVE)).alias("internal_only")))


def rights(declared: Column) -> Column:
    """VERIFIED, INTERNAL_ONLY, UNKNOWN or REVIEW; the verified list is tried first."""
    name = F.upper(T.strip(F.coalesce(declared, F.lit("UNKNOWN"))))
    return F.when(name.isin(*VERIFIED), "LICENSE_VERIFIED").when(name.isin(*INTERNAL), "INTERNAL_ONLY").when(name.isin("UNKNOWN", "UNSPECIFIED", "NONE", ""), "LICENSE_UNKNOWN").otherwise("RIGHTS_REVIEW_REQUIRED")


def topic(title: Column, text: Column) -> Column:
    """Struct (domain, subtopic, confidence) by keywords of the title and the text."""
    sample = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), text))
    made = lambda d, s, c: F.struct(F.lit(d).alias("domain"), F.lit(s).alias("subtopic"), F.lit(c).alias("confidence"))
    out = None
    for name, pattern in TOPICS:
        out = (F.when if out is None else out.when)(sample.rlike(pattern), made("science", name, 0.85))
    for name, pattern in FIELDS:
        out = out.when(sample.rlike(pattern), made(name, name, 0.85))
    return out.otherwise(made("science", "general_physics", 0.70))


def audit(text: Column, shortest: int = 100) -> Column:
    """Struct (score, status) of a text: short, broken characters, repeated lines, characters that do not print."""

    def measured(bare, lines):
        broken = T.occurrences(bare, "�")
        repeats = F.lit(1.0) - F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))
        unseen = F.length(bare) - F.length(F.regexp_replace(bare, r"[[\p{C}\p{Z}]&&[^ \n\t\r]]", ""))
        score = (
            F.lit(1.0)
            - F.when(F.length(bare) < shortest, 0.3).otherwise(0.0)
            - F.least(F.lit(0.4), broken * 0.05)
            - F.when((F.size(lines) >= 4) & (repeats > 0.25), 0.25).otherwise(0.0)
            - F.when(unseen > 0.05 * F.length(bare), 0.4).otherwise(0.0)
        )
        return F.when(bare == "", 0.0).otherwise(F.round(F.greatest(F.lit(0.0), score), 4))

    def judged(score):
        return F.struct(score.alias("score"), F.when(score >= 0.85, "PASSED").when(score >= 0.5, "WARNING").otherwise("REJECTED").alias("status"))

    lines_of = lambda bare: F.filter(F.transform(F.split(bare, "\n"), T.strip), lambda x: x != "")
    score = T.let(T.strip(F.coalesce(text, F.lit(""))), lambda bare: T.let(lines_of(bare), lambda lines: measured(bare, lines)))
    return T.let(score, judged)


def state(score: Column, open_fence: Column, least: float = 0.85) -> Column:
    """UNSCORED, PASSED or FAILED; an open code fence costs 0.15 once."""
    after = F.greatest(F.lit(0.0), score - F.when(open_fence, 0.15).otherwise(0.0))
    return F.struct(F.round(after, 4).alias("score"), F.when(score.isNull(), "UNSCORED").when(after >= least, "PASSED").otherwise("FAILED").alias("state"))


@EVALUATORS.register("text_audit")
def text_score(text: Column) -> Column:
    """The score of :func:`audit`."""
    return audit(text)["score"]


def score_state(score: Column, minimum: float = 0.85) -> Column:
    """PASSED, FAILED or UNSCORED."""
    return F.when(score.isNull() | F.isnan(score), "UNSCORED").when(score >= minimum, "PASSED").otherwise("FAILED")


def accepted(score: Column, minimum: float = 0.85, enforce: bool = True, allow_unscored: bool = True) -> Column:
    """Whether a record is taken: passed ones always, failed ones unless the minimum is enforced, unscored ones if they are allowed."""
    found = score_state(score, minimum)
    return (found == "PASSED") | ((found == "FAILED") & F.lit(not enforce)) | ((found == "UNSCORED") & F.lit(allow_unscored))
