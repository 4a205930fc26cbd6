"""Language, direction, lexicon classification, PII patterns, medical extraction and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.functions.normalize import ARABIC, bound

# PII patterns in the order of redaction, with their risk.
PII = [
    ("CREDIT_CARD", "high", r"\b(?:\d[ -]*?){13,16}\b"),
    ("EMAIL_ADDRESS", "medium", r"\b[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\b"),
    ("PHONE_NUMBER", "medium", r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"),
    ("IP_ADDRESS", "low", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("SSN", "high", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("API_KEY", "high", r"""(?i)(?:api[_-]?key|token|secret|password)\s*[:=]\s*['"]?[a-zA-Z0-9_\-]{20,}['"]?"""),
    ("JWT_TOKEN", "high", r"eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*"),
    ("AWS_KEY", "high", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("PRIVATE_KEY", "critical", r"-----BEGIN(?: RSA | EC | DSA | OPENSSH | )PRIVATE KEY-----"),
    ("IBAN", "high", r"\b[A-Z]{2}\d{2}[A-Z0-9]{4,}"),
]
LEVELS = ["none", "low", "medium", "high", "critical"]

# Dose ranges in mg, interacting drugs, protected attributes.
DOSES = {"paracetamol": (250, 1000), "acetaminophen": (250, 1000), "ibuprofen": (200, 800), "amoxicillin": (250, 1000), "metformin": (500, 2000), "atorvastatin": (10, 80), "lisinopril": (2.5, 40), "amlodipine": (2.5, 10), "omeprazole": (10, 40), "aspirin": (75, 325)}
INTERACTIONS = [("warfarin", "aspirin"), ("metformin", "contrast"), ("lisinopril", "spironolactone"), ("simvastatin", "clarithromycin")]
PROTECTED = {
    "laterality": ("critical", "أيمن أيسر ثنائي أمامي خلفي جانبي إنسي وحشي علوي سفلي قحفي ذيلي ظهري بطني right left bilateral anterior posterior lateral medial superior inferior cranial caudal dorsal ventral proximal distal".split()),
    "severity": ("high", [*"حاد مزمن خفيف متوسط شديد بسيط خطير مستعصٍ".split(), "مهدد للحياة", *"acute chronic mild moderate severe life-threatening critical minor serious refractory intractable".split()]),
    "fracture_type": ("critical", "مفتوح مغلق مضاعف شعري مُحيط منفصل مضغوط ملتوي منزلق open closed comminuted hairline greenstick displaced compressed spiral impacted transverse oblique pathological".split()),
    "temporal": ("medium", "حديث قديم متكرر مستعصٍ حادث سابق مبكر متأخر مؤقت دائم recent old recurrent persistent previous early late temporary permanent acute subacute".split()),
    "body_region": ("medium", [*"العنق الظهر الصدر البطن الحوض الركبة الكتف المرفق الرسغ الكاحل".split(), "العمود الفقري", *"cervical thoracic lumbar sacral pelvic shoulder elbow wrist ankle spine femoral tibial humeral radial".split()]),
}


def script_counts(c: Column) -> tuple[Column, Column]:
    """Arabic and Latin letters."""
    return F.regexp_count(c, F.lit(ARABIC)), F.regexp_count(c, F.lit("[A-Za-z]"))


def language(c: Column, threshold: float = 0.70, strict: bool = False) -> Column:
    """struct<lang,confidence>: ar or en from the threshold on, else mixed; unknown without text.

    strict asks for more than the threshold and calls texts without letters unknown.
    """
    over = (lambda s: s > threshold) if strict else (lambda s: s >= threshold)

    def told(counts: Column) -> Column:
        ar, en = F.get(counts, F.lit(0)), F.get(counts, F.lit(1))
        total = ar + en
        share_ar, share_en = F.when(total > 0, ar / total).otherwise(0.0), F.when(total > 0, en / total).otherwise(0.0)
        lang = F.when(F.coalesce(F.trim(c), F.lit("")) == "", "unknown").when(total == 0, "unknown" if strict else "mixed").when(over(share_ar), "ar").when(over(share_en), "en").otherwise("mixed")
        return F.struct(lang.alias("lang"), F.bround(F.greatest(share_ar, share_en), 4).alias("confidence"))

    return bound(F.array(*script_counts(c)), told)  # each script is counted once, not once per use


def direction(c: Column) -> Column:
    """rtl or ltr over 0.7 of the letters, else mixed; ltr without letters."""
    ar, en = script_counts(c)
    return F.when(ar + en == 0, "ltr").when(ar / (ar + en) > 0.7, "rtl").when(en / (ar + en) > 0.7, "ltr").otherwise("mixed")


def is_rtl(c: Column) -> Column:
    ar, en = script_counts(c)
    return F.when(ar + en == 0, False).otherwise(ar / (ar + en) > 0.3)


def keyword_class(c: Column, lexicon: dict[str, str], floor: float = 0.15) -> Column:
    """struct<category,confidence>: share of regex hits; general under floor or without hits. Hits are counted once."""
    counts = F.array(*[F.struct(F.regexp_count(c, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate(lexicon.items())])

    def judged(x: Column) -> Column:
        total, best = F.aggregate(x, F.lit(0), lambda a, y: a + y.n), F.array_max(x)
        share = F.when(total > 0, best.n / total).otherwise(0.3)
        return F.struct(F.when((total == 0) | (share < floor), "general").otherwise(best.k).alias("category"), F.round(share, 6).alias("confidence"))

    return bound(counts, judged)


def weighted_class(c: Column, lexicon: dict[str, tuple[str, str, str]]) -> Column:
    """struct<category,score,share>: hits weighted 3, 2, 1 by level of importance; also the share of all."""
    score = lambda p: 3 * F.regexp_count(c, F.lit(p[0])) + 2 * F.regexp_count(c, F.lit(p[1])) + F.regexp_count(c, F.lit(p[2]))
    scores = F.array(*[F.struct(score(p).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate(lexicon.items())])

    def judged(x: Column) -> Column:
        total, best = F.aggregate(x, F.lit(0), lambda a, y: a + y.n), F.array_max(x)
        return F.struct(F.when(best.n > 0, best.k).otherwise("general").alias("category"), best.n.alias("score"), F.round(F.when(total > 0, best.n / total).otherwise(0.0), 6).alias("share"))

    return bound(scores, judged)


def pii_counts(c: Column, patterns: list[tuple[str, str, str]] | None = None) -> list[Column]:
    """One count column per pattern."""
    return [F.regexp_count(c, F.lit(p)).alias(name.lower()) for name, _, p in patterns or PII]


def risk(c: Column, patterns: list[tuple[str, str, str]] | None = None) -> Column:
    """The worst level of the patterns that occur."""
    ranks = [F.when(c.rlike(p), LEVELS.index(level)).otherwise(0) for _, level, p in patterns or PII]
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(F.greatest(*ranks), F.lit(0)) + 1)


def anonymised(c: Column, patterns: list[tuple[str, str, str]] | None = None, mask: str = "[REDACTED]") -> Column:
    """Patterns replaced in order; earlier ones take what later ones would match."""
    return reduce(lambda x, p: F.regexp_replace(x, p[2], mask), patterns or PII, c)


def with_pattern(patterns: list[tuple[str, str, str]], name: str, level: str, regex: str) -> list[tuple[str, str, str]]:
    """patterns and one more; level must be known and regex must compile."""
    import re

    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    re.compile(regex)
    return [*patterns, (name, level, regex)]


def secret_lines(df: DataFrame, text: str, key: str, patterns: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """key, line_no, kind, level for every line that a pattern matches."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    hits = F.array(*[F.when(F.col("line").rlike(p), F.struct(F.lit(n).alias("kind"), F.lit(level).alias("level"))) for n, level, p in patterns or PII])
    return lines.select(key, (F.col("line_no") + 1).alias("line_no"), F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "line_no", "h.kind", "h.level")


def attributes(c: Column) -> Column:
    """struct of the protected words of each class that occur in the text."""
    low = F.lower(c)
    return F.struct(*[F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)).alias(k) for k, (_, words) in PROTECTED.items()])


def merge_conflicts(a: Column, b: Column) -> Column:
    """Names of the classes whose words occur in both texts and differ; empty means safe to merge."""
    x, y = attributes(a), attributes(b)
    clash = lambda k: (F.size(x[k]) > 0) & (F.size(y[k]) > 0) & (F.array_sort(x[k]) != F.array_sort(y[k]))
    return F.filter(F.array(*[F.when(clash(k), F.lit(k)) for k in PROTECTED]), lambda v: v.isNotNull())


def merge_severity(conflicts: Column) -> Column:
    """The worst level of the classes in conflict, none if there is none."""
    ranks = F.create_map(*[F.lit(x) for k, (level, _) in PROTECTED.items() for x in (k, LEVELS.index(level))])
    worst = F.array_max(F.transform(conflicts, lambda k: ranks[k]))
    return F.element_at(F.array(*map(F.lit, LEVELS)), F.coalesce(worst, F.lit(0)) + 1)


def drugs(c: Column) -> Column:
    """Known drugs that occur, sorted."""
    known = sorted({*DOSES, *(d for pair in INTERACTIONS for d in pair)})
    return F.filter(F.array(*map(F.lit, known)), lambda d: F.contains(F.lower(c), d))


def interactions(c: Column) -> Column:
    """Interacting pairs of which both drugs occur, in either order."""

    def pairs(found: Column) -> Column:
        pair = lambda p: F.when(F.array_contains(found, p[0]) & F.array_contains(found, p[1]), F.lit("+".join(sorted(p))))
        return F.filter(F.array(*[pair(p) for p in INTERACTIONS]), lambda v: v.isNotNull())

    return bound(drugs(c), pairs)


DOSAGE = r"(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|IU|units?)\b"


def dosages(c: Column) -> Column:
    """array<struct<amount,unit>> of the dosages of a text."""
    amount, unit = (F.regexp_extract_all(c, F.lit("(?i)" + DOSAGE), F.lit(i)) for i in (1, 2))
    return F.zip_with(amount, unit, lambda a, u: F.struct(a.cast("double").alias("amount"), F.lower(u).alias("unit")))


def dose_issues(c: Column) -> Column:
    """array<struct<drug,amount,level>>: amounts within 50 characters of a drug outside its range."""

    def judged(drug: str, low: float, high: float) -> Column:
        near = F.regexp_extract_all(c, F.lit(rf"(?i){drug}.{{0,50}}?\b{DOSAGE}"), F.lit(1))
        level = lambda a: F.when(a < low, "WARNING").when(a > high, "ERROR").otherwise("OK")
        return F.transform(near, lambda a: F.struct(F.lit(drug).alias("drug"), a.cast("double").alias("amount"), level(a.cast("double")).alias("level")))

    found = [judged(drug, low, high) for drug, (low, high) in DOSES.items()]
    return F.filter(F.flatten(F.array(*found)), lambda x: x.level != "OK")


def laterality_conflicts(c: Column) -> Column:
    """Number of sentences that name both sides."""
    return F.size(F.filter(F.split(F.lower(c), r"\."), lambda s: s.rlike(r"\bright\b") & s.rlike(r"\bleft\b")))


def validator_confidence(levels: Column) -> Column:
    """0.95 without issues, else 1 less a penalty per issue, 0.3 at least."""
    cost = F.create_map(*[F.lit(x) for kv in {"INFO": 0.05, "WARNING": 0.15, "ERROR": 0.30, "CRITICAL": 0.50}.items() for x in kv])
    total = F.aggregate(levels, F.lit(0.0), lambda a, x: a + F.coalesce(cost[x], F.lit(0.0)))
    return F.when(F.size(levels) == 0, 0.95).otherwise(F.greatest(F.lit(0.3), 1 - total))


CRITICAL = {"dosage": r"\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|IU|units?)\b", "frequency": r"\b(?:BID|TID|QID|QD|QOD|PRN|STAT)\b", "route": r"\b(?:IV|IM|PO|SC|SL|PR|PV)\b", "drug": r"\b[A-Za-z]+(?:cillin|mycin|pril|olol|statin|azole|pine)\b", "lab_value": r"\b\d+(?:\.\d+)?\s*(?:mmol/L|mg/dL|g/dL|%)"}


def critical_content(c: Column) -> Column:
    """map of each category of critical content to its matches."""
    return F.create_map(*[x for k, p in CRITICAL.items() for x in (F.lit(k), F.regexp_extract_all(c, F.lit(p), F.lit(0)))])


def dual_decision(similarity: Column, a: Column, b: Column) -> Column:
    """Decision on two readings of a line from their similarity and their critical content."""
    x, y = critical_content(a), critical_content(b)
    differ = reduce(lambda p, q: p | q, [F.size(x[k]) != F.size(y[k]) for k in CRITICAL]) | (x["dosage"] != y["dosage"]) | (x["lab_value"] != y["lab_value"])
    return F.when((similarity >= 0.85) & ~differ, "AUTO_ACCEPT").when((similarity < 0.60) | differ, "MANUAL_REVIEW_REQUIRED").otherwise("QUICK_CHECK")


def routed_engines(profile: Column, lang: Column, quality: Column, most: int = 3) -> Column:
    """Engines to try, best first, from profile, language and image quality."""
    fast, full = ["tesseract", "easyocr"], ["surya", "trocr", "paddleocr", "easyocr", "tesseract"]
    pick = F.when(profile == "fast", F.array(*map(F.lit, fast))).when((lang == "ar") & (quality < 0.5), F.array(*map(F.lit, ["surya", "easyocr", "tesseract"]))).when(quality < 0.5, F.array(*map(F.lit, ["trocr", "surya", "paddleocr"]))).otherwise(F.array(*map(F.lit, full)))
    return F.slice(pick, 1, most)


INJECTION = [r"(?i)<script", r"(?i)\b(?:union\s+select|drop\s+table|insert\s+into|delete\s+from)\b", r"(?i)javascript:", r"\.\./"]


def unsafe_input(c: Column, longest: int = 10_000) -> Column:
    """A text that is too long or holds a pattern of the deny list."""
    return (F.char_length(c) > longest) | reduce(lambda a, b: a | b, [c.rlike(p) for p in INJECTION])


def file_kind(path: Column) -> Column:
    """Category of a file by its extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kinds = {"image": ["png", "jpg", "jpeg", "gif", "tif", "tiff", "bmp", "webp"], "document": ["pdf", "doc", "docx", "odt", "rtf"], "text": ["txt", "md", "csv", "json", "jsonl", "xml", "html"], "archive": ["zip", "tar", "gz", "7z", "rar"], "audio": ["mp3", "wav", "flac"], "video": ["mp4", "avi", "mkv", "mov"], "code": ["py", "js", "ts", "java", "c", "cpp", "go", "rs"]}
    return reduce(lambda a, kv: a.when(ext.isin(kv[1]), kv[0]), list(kinds.items())[1:], F.when(ext.isin(kinds["image"]), "image")).otherwise("other")


def span_list(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """array<struct<kind,start,end,value>> of every match, pattern by pattern; positions come from cumulative splits, JVM-side."""

    def walk(kind: str, p: str) -> Column:
        return bound(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)), lambda found: placed(kind, p, found))

    def placed(kind: str, p: str, found: Column) -> Column:
        steps = F.aggregate(
            F.zip_with(F.split(text, p), found, lambda a, b: F.struct(F.char_length(a).alias("gap"), b.alias("m"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("s")),
            lambda acc, x: F.when(x.m.isNull(), acc).otherwise(F.struct((acc.at + x.gap + F.char_length(x.m)).alias("at"), F.concat(acc.s, F.array(F.struct(F.lit(kind).alias("kind"), (acc.at + x.gap).alias("start"), (acc.at + x.gap + F.char_length(x.m)).alias("end"), x.m.alias("value")))).alias("s"))),
            lambda acc: acc.s,
        )
        return F.when(F.size(found) > 0, steps).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>"))

    return F.concat(*[walk(kind, p) for kind, p in patterns])


def each(rows: DataFrame) -> DataFrame:
    """Rows of explode_outer(...) AS x without the empty ones: before a plain explode Spark puts a filter that works out the whole list a second time."""
    return rows.where("x is not null")


def spans(df: DataFrame, text: str, patterns: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """keep, kind, start, end, value of every match, in one pass over df."""
    rows = each(df.select(*keep, F.explode_outer(span_list(F.col(text), patterns)).alias("x")))
    return rows.select(*keep, "x.kind", "x.start", "x.end", "x.value")


def greedy_spans(found: Column) -> Column:
    """Of array<struct<start,end,...>> the spans that start at or after the last kept end."""
    return F.aggregate(F.slice(F.array_sort(found), 2, F.greatest(F.size(found) - 1, F.lit(0))), F.slice(F.array_sort(found), 1, 1), lambda acc, s: F.when(s.start >= F.element_at(acc, -1).end, F.concat(acc, F.array(s))).otherwise(acc))
