"""Methodology screens: reagents, ethics approvals, timelines, agreement of methods and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vendor keys in order of preference, and the pattern of their catalogue numbers (fixed values).
VENDORS = [
    ("abcam", r"^ab\d{4,7}$"),
    ("sigma", r"^[A-Z]\d{4,6}$"),
    ("sigma-aldrich", r"^[A-Z]\d{4,6}$|^[A-Z]{2,4}\d{2,5}$"),
    ("thermo", r"^\d{4,6}[A-Z]{0,2}$|^[A-Z]\d{4,6}$"),
    ("thermo fisher", r"^\d{4,6}[A-Z]{0,2}$|^[A-Z]\d{4,6}$"),
    ("invitrogen", r"^\d{4,6}[A-Z]{0,2}$"),
    ("cst", r"^\d{4,5}[A-S]$"),
    ("cell signaling", r"^\d{4,5}[A-S]$"),
    ("santa cruz", r"^sc-\d{4,6}$"),
    ("r&d", r"^[A-Z]{2,5}\d{4,6}$"),
    ("r&d systems", r"^[A-Z]{2,5}\d{4,6}$"),
    ("millipore", r"^[A-Z]{2,5}\d{4,6}$"),
    ("bd biosciences", r"^\d{6}$|^[A-Z]\d{4,6}[A-Z]{0,2}$"),
    ("roche", r"^\d{7,11}$"),
    ("qiagen", r"^\d{5,7}$"),
    ("promega", r"^[A-Z]\d{3,5}[A-Z]{0,2}$"),
    ("neb", r"^[A-Z]\d{4,5}[A-Z]{0,2}$"),
    ("new england biolabs", r"^[A-Z]\d{4,5}[A-Z]{0,2}$"),
]
SUSPICIOUS_VENDORS = ("biosharp", "biotech", "chemical reagents co", "lab supplies inc", "biochem co ltd")
ANY_CATALOGUE = r"^[A-Z]{0,3}[-]?\d{3,8}[A-Z]{0,3}$"
#: Patterns of approval numbers by country, and of made-up ones (fixed values).
APPROVALS = {
    "china": [r"伦审.*第.*号", r"[A-Z]{2,6}[-_]\d{4}[-_]\d{2,6}", r"\d{4}[-_](?:伦|化|动|医).*\d{2,4}号", r"(?:IACUC|IRB)[-_]\d{4}[-_]\d{2,6}"],
    "us": [r"(?:IACUC|IRB|A\d{4})[-_]\d{2,4}[-_]\d{2,6}", r"PROTO(?:COL)?[-_]\d{4,8}", r"[A-Z]{2,4}[-_]\d{4}[-_]\d{2,4}"],
    "eu": [r"2010[/ ]63[/ ]EU", r"[A-Z]{2,4}[/-]\d{4}[/-]\d{2,6}", r"(?:DE|FR|NL|IT|ES)[-_/]\d{2,4}[-_/]\d{2,6}"],
    "uk": [r"PPL\s*\d{2}[/-]\d{4}", r"P[ABCDEF]\s*\d{2}[/-]\d{4}", r"\d{2}[/-]NW[/-]\d{4}[/-]\d{2}", r"(?:REC|IRAS)\s*\d{2,6}[/-]\d{2,6}"],
    "japan": [r"第\s*\d{2,4}\s*号", r"[A-Z]{2,5}[-_]\d{2}[-_]\d{2,4}", r"\d{4}[-_]倫\d{2,4}"],
}
FAKE_APPROVALS = [r"^12345$", r"^[A-Z]{3}-\d{3}$", r"(?i)^approval[\s_-]?\d+$", r"(?i)^no\.?\s*\d{1,3}$", r"(?i)^[a-z]+$"]


def strip(c: Column) -> Column:
    """Without white space at both ends; null as empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def _named(*cases: tuple[str, Column]) -> Column:
    """Names of the cases that hold, in order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(when, F.lit(False)), F.lit(name)) for name, when in cases]))


def reagents(items: DataFrame) -> DataFrame:
    """(name, vendor, catalog_number[, model]): the first vendor key within the vendor's name decides the number's pattern,
    a general one any other vendor's; a number without a vendor isn't judged. Vague vendors and antibodies without a number."""
    given, vendor = F.coalesce("vendor", F.lit("")), F.lower(strip(F.col("vendor")))
    number = F.coalesce(F.nullif("catalog_number", F.lit("")), *(["model"] if "model" in items.columns else []), F.lit(""))
    key, fits = F.lit(None).cast("string"), F.lit(True)
    for name, pattern in reversed(VENDORS):
        here = vendor.contains(name)
        key, fits = F.when(here, F.lit(name)).otherwise(key), F.when(here, strip(number).rlike(f"(?i){pattern}")).otherwise(fits)
    vague = F.greatest(*[vendor.contains(name) for name in SUSPICIOUS_VENDORS])
    out = items.withColumns({"vendor_key": F.when(number != "", key)})
    issues = _named(
        ("format_mismatch", (number != "") & key.isNotNull() & ~fits), ("unrecognized_format", (number != "") & key.isNull() & (given != "") & ~strip(number).rlike(ANY_CATALOGUE)),
        ("vague_vendor", vague), ("missing_catalog", (number == "") & F.lower(F.coalesce("name", F.lit(""))).contains("antibod")),
    )
    return out.withColumn("issues", issues).withColumn("flagged", F.size("issues") > 0)


def ethics(rows: DataFrame) -> DataFrame:
    """(approval_number, country, study_type): a missing number; else a made-up one, a short one, one unlike its country's
    (of the countries with patterns), and one unlike any country's if the country is unknown and nothing else was found."""
    number, country = strip(F.col("approval_number")), F.lower(strip(F.coalesce("country", F.lit("unknown"))))
    fake, unlike, like_any = F.lit(False), F.lit(False), F.lit(False)
    for pattern in FAKE_APPROVALS:
        fake = fake | number.rlike(pattern)
    for name, patterns in APPROVALS.items():
        own = number.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        unlike, like_any = unlike | ((country == name) & ~own), like_any | own
    short, there = F.length(number) < 5, number != ""
    findings = _named(
        ("missing", ~there), ("likely_fabricated", there & fake), ("too_short", there & short), ("format_mismatch_country", there & unlike),
        ("format_unknown", there & (country == "unknown") & ~like_any & ~fake & ~short),
    )
    return rows.withColumn("findings", findings).withColumn("flagged", F.size("findings") > 0)


def _numbers(text: Column, pattern: str) -> Column:
    """The first group of all matches, as whole numbers."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1), lambda x: x.cast("long"))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda total, x: total + x)


def _date(text: Column) -> Column:
    """Of its first ten characters, as year, month and day; null if they aren't a date."""
    head = F.substring(strip(text), 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(head, "yyyy-M-d"))


def timelines(rows: DataFrame) -> DataFrame:
    """(claimed_duration, submission_date, publication_date, animal_age_at_start, treatment_duration): days that the claimed
    duration and the treatment add up to (weeks of 7, months of 30), and findings: a submission date that is none, more than
    52 weeks of age and treatment where a date is known, treatment of both eyes."""
    claimed, age, treated = (F.coalesce(c, F.lit("")) for c in ("claimed_duration", "animal_age_at_start", "treatment_duration"))
    days = F.lit(0).cast("long")
    for unit, size in (("day", 1), ("week", 7), ("month", 30)):
        for text in (claimed, treated):
            days = days + size * _total(_numbers(text, rf"(?i)(\d+)\s*{unit}s?"))
    first = lambda text, unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(?i)(\d+)[-\s]*{unit}s?", 1), F.lit("")).cast("long"), F.lit(0))
    begin, weeks = first(age, "week"), first(treated, "week") + 4 * first(treated, "month")
    known = F.coalesce(_date(F.col("submission_date")), _date(F.col("publication_date"))).isNotNull()
    findings = _named(
        ("date_parse_error", (F.coalesce("submission_date", F.lit("")) != "") & _date(F.col("submission_date")).isNull()),
        ("long_timeline", known & (begin > 0) & (weeks > 0) & (begin + weeks > 52)), ("both_eyes_concern", claimed.rlike(r"(?i)both\s*eyes")),
    )
    return rows.withColumns({"estimated_days": F.nullif(days, F.lit(0)), "findings": findings}).withColumn("flagged", F.size("findings") > 0)


#: Sample sizes in a Methods section, alone and by group (fixed patterns).
SIZES = (r"(?i)(?:n\s*[=＝]\s*|sample\s*size\s*(?:of|:)?\s*)(\d+)", r"(?i)(\d+)\s*(?:mice|rats|animals|samples|specimens|cells|wells?|replicates?)\s*(?:per|each|/)\s*(?:group|condition|treatment)")
#: Tests as Methods and as Results name them (fixed patterns).
TESTS = {
    "anova": (r"(?i)\bANOVA\b|analysis\s*of\s*variance", r"(?i)\bANOVA\b|F\s*\(\d+"),
    "ttest": (r"(?i)\bt[- ]test\b|Student'?s?\s*t", r"(?i)\bt[- ]test\b|Student'?s?\s*t|t\s*[=＝]|t\s*\(\d+\)"),
    "nonparametric": (r"(?i)\bMann.Whitney\b|\bWilcoxon\b|\bKruskal.Wallis\b", ""),
}


def methods_agreement(rows: DataFrame) -> DataFrame:
    """(methods_text, results_text): different sample sizes within Methods; ANOVA there but only t tests in Results; only males
    there but females in Results. Five checks are made, of which these can find something."""
    methods, results = F.coalesce("methods_text", F.lit("")), F.coalesce("results_text", F.lit(""))
    sizes = F.array_sort(F.array_distinct(F.concat(*[_numbers(methods, p) for p in SIZES])))
    out = rows.withColumns({"n_values": sizes, "checks_performed": F.lit(5), **{name: methods.rlike(own) for name, (own, _) in TESTS.items()}})
    findings = _named(
        ("n_value_inconsistency", F.size("n_values") > 1), ("stat_method_contradiction", F.col("anova") & ~results.rlike(TESTS["anova"][1]) & results.rlike(TESTS["ttest"][1])),
        ("gender_contradiction", methods.rlike(r"(?i)\bmale\b") & ~methods.rlike(r"(?i)\bfemale\b") & results.rlike(r"(?i)\bfemale\b")),
    )
    return out.withColumn("findings", findings).withColumn("flagged", F.size("findings") > 0)
