"""Personnel movements: keyword types, names, roles and courts read from text, with a confidence and a review state."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import lexicon, wordings
from quillspark.functions.matching import PATTERN, Lexicons, let
from quillspark.functions.text import squeeze
from quillspark.operators.frame import settled
from quillspark.operators.heatmap import _rank_when

def text_of(*columns: str) -> Column:
    return squeeze(F.concat_ws(" ", *columns))


def _any_part(low: Column, parts: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(low, F.lit(p)) for p in parts])


def _name(text: Column, low: Column) -> Column:
    """The first name by the patterns; ``low``, the text in lower case, says which of them can match at all."""

    def kept(n: Column) -> Column:
        return let(n, lambda n: F.when((n != "") & (F.size(F.split(n, r"\s+")) <= 5) & ~n.rlike(lexicon.NAME_REFUSED), n))

    out = []
    for pattern, parts in zip(lexicon.NAME_PATTERNS, lexicon.NAME_PARTS, strict=True):
        n = F.element_at(F.split(F.regexp_extract(text, pattern, 1), r"[.;:,]\s+"), 1)
        for end in lexicon.NAME_ENDS:
            n = F.regexp_replace(n, end, "")
        out.append(F.when(_any_part(low, parts), kept(F.trim(n))))
    return F.coalesce(*out, F.lit(""))


def _role(text: Column, low: Column, kind: Column) -> Column:
    found = [F.when(F.contains(low, F.lit(lead)), F.nullif(F.trim(F.regexp_extract(text, rf"(?i)\b{lead}{lexicon.ROLE_ENDS}", 1)), F.lit(""))) for lead in lexicon.ROLE_LEADS]
    chief = F.when(kind == "leadership_change", F.nullif(F.regexp_extract(text, lexicon.CHIEF_ROLES, 1), F.lit("")))
    return F.coalesce(*found, chief, F.when(kind == "elevation", F.lit("Elevation")), F.lit(""))


def _first_named(text: Column, low: Column, names: tuple[str, ...]) -> Column:
    """The first of the names, in list order, that a text has between word bounds; empty if none."""
    return F.coalesce(*[F.when(F.contains(low, F.lit(n.lower())) & text.rlike(rf"(?i)\b{n}\b"), F.lit(n)) for n in names], F.lit(""))


def detect_movements(items: DataFrame, keywords=lexicon.MOVEMENT_KEYWORDS, threshold: int = 42, source_pattern: str = r"court|judiciar|ministry|government|gazette|bar|law society") -> DataFrame:
    """Items that report a movement: movement_type, judge_name, court, place, new_role, confidence, status, keywords.

    ``place`` is the first of the jurisdictions that the text names, empty if none.
    """
    out = settled(items, {"__x": text_of("title", "summary", "country", "category", "source", "source_tab")})
    out = settled(out, {"__low": F.lower("__x")})
    x, low = F.col("__x"), F.col("__low")
    pairs = [(kind, word) for kind, words in keywords.items() for word in words]
    hits = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w)), F.struct(F.lit(k).alias("kind"), F.lit(w).alias("word"))) for k, w in pairs]))
    said = Lexicons(PATTERN, judge=lexicon.JUDGE_WORDS, speech=lexicon.SPEECH_WORDS, move=lexicon.MOVE_WORDS)
    speech = said.found(low, lambda words, t: said.any("judge", words, t) & said.any("speech", words, t) & ~said.any("move", words, t))
    # Items without a keyword, or that report a speech, have no confidence, so names and roles are read from the others alone.
    out = settled(out, {"__h": hits})
    out = settled(out.filter(F.size("__h") > 0) if threshold > 0 else out, {"__speech": F.when(F.size("__h") > 0, speech).otherwise(True)})
    out = out.filter(~F.col("__speech")) if threshold > 0 else out
    kind = _rank_when([(F.array_contains(F.transform("__h", lambda h: h["kind"]), k), k) for k in lexicon.MOVEMENT_PRIORITY], "unknown")
    court, place = _first_named(x, low, lexicon.COURTS), _first_named(x, low, lexicon.JURISDICTIONS)
    out = settled(out, {"movement_type": kind, "court": court, "place": place, "judge_name": _name(x, low)})
    out = settled(out, {"new_role": _role(x, low, F.col("movement_type"))})
    source = F.lower(F.concat_ws(" ", "source", "source_tab", "category"))
    own = F.lower(F.concat_ws(" ", "title", "summary"))
    points = lambda condition, n: F.when(condition, n).otherwise(0)
    score = (
        28
        + F.least(F.lit(26), F.size("__h") * 8)
        + points(F.col("movement_type").isin("appointment", "elevation", "leadership_change", "retirement"), 10)
        + points(F.col("judge_name") != "", 14)
        + points(F.col("court") != "", 10)
        + points(F.col("new_role") != "", 10)
        + points(source.rlike(source_pattern), 8)
        + points(source.rlike("press release|judiciary updates"), 8)
        + points((F.col("judge_name") == "") & F.contains(own, F.lit("elevation")), 10)
        + points(F.contains(source, F.lit("news")), 4)
    )
    out = settled(out, {"confidence": F.when(F.col("__speech") | (F.size("__h") == 0), 0).otherwise(F.least(F.lit(100), score))})
    sure = (F.col("confidence") >= 70) & (F.col("judge_name") != "") & ((F.col("new_role") != "") | (F.col("court") != ""))
    found = out.filter(F.col("confidence") >= threshold)
    return found.withColumns({"status": F.when(sure, "detected").otherwise("needs_review"), "keywords": F.array_distinct(F.transform("__h", lambda h: h["word"]))}).drop("__x", "__low", "__h", "__speech")


def confidence_label(confidence: Column) -> Column:
    return _rank_when([(confidence >= 80, "High"), (confidence >= 60, "Medium")], "Low")


def hydrate(movements: DataFrame, reviews: DataFrame, fields=("status", "judge_name", "court", "new_role")) -> DataFrame:
    """Movements with reviewed fields laid over detected ones."""
    own = reviews.select("id", *[F.col(f).alias(f"__{f}") for f in fields if f in reviews.columns])
    out = movements.join(own, "id", "left")
    return out.withColumns({f: F.coalesce(f"__{f}", f) for f in fields if f in reviews.columns}).drop(*[f"__{f}" for f in fields])


def funnel(movements: DataFrame) -> DataFrame:
    """Review funnel in one pass."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return movements.agg(F.count("*").alias("total"), n("detected"), n("needs_review"), n("approved"), n("dismissed"))


def filtered(movements: DataFrame, *, country: str | None = None, kind: str | None = None, band: str | None = None, status: str | None = None) -> DataFrame:
    """Movements of a country, type, confidence band (High, Medium, Low) and review state; None or 'All' lets all pass."""
    asked = {"country": country, "movement_type": kind, "status": status}
    out = movements
    for column, value in asked.items():
        out = out.filter(F.col(column) == value) if value not in (None, "All") else out
    return out.filter(confidence_label(F.col("confidence")) == band) if band not in (None, "All") else out


def fallback_id(text: Column) -> Column:
    """A short id of a text: code units folded as h * 31 + c in 32 signed bits, its magnitude in base 36."""
    wrap = lambda x: F.pmod(x + F.lit(2147483648), F.lit(4294967296)) - F.lit(2147483648)
    units = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    # A character beyond the basic plane is two units: its code is high * 65536 + low.
    each = F.flatten(F.transform(units, lambda u: F.when(u > 65535, F.array(F.floor(u / 65536), u % 65536)).otherwise(F.array(u))))
    folded = F.aggregate(each, F.lit(0).cast("long"), lambda h, u: wrap(h * 31 + u))
    return F.lower(F.conv(F.abs(folded).cast("string"), 10, 36))


def draft(movements: DataFrame, *, tone: str = "Formal judiciary", output: str = "Email", organisation: str = "[Organisation/Team]", sender: str = "[Sender Name]") -> DataFrame:
    """subject, body, missing fields and whether a draft can be approved, in a tone and for an output.

    Outputs: Email and Formal letter, LinkedIn/internal post, Short executive note. A name is always needed, a role
    or a court unless someone retires or is honoured. Where movements have no country, none is named.
    """
    kind = F.col("movement_type")
    role = _rank_when([(F.col("new_role") != "", F.col("new_role")), (kind == "retirement", "your judicial service"), (kind == "honour", "this honour")], "[New Role]")
    name = F.when(F.col("judge_name") != "", F.col("judge_name")).otherwise("[Judge Name]")
    court = F.when(F.col("court") != "", F.concat(F.lit(" at "), F.col("court"))).otherwise("")
    country = F.when(F.coalesce("country", F.lit("")) != "", F.concat(F.lit(" in "), F.col("country"))).otherwise("") if "country" in movements.columns else F.lit("")
    placeless = (F.col("new_role") == "") & (F.col("court") == "") & ~kind.isin("retirement", "honour")
    missing = F.array_compact(F.array(F.when(F.col("judge_name") == "", F.lit("judge name")), F.when(placeless, F.lit("new role or court"))))
    subject = F.when(kind == "retirement", "Congratulations on your judicial service").otherwise(F.concat(F.lit("Congratulations on your appointment as "), role))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    if output == "LinkedIn/internal post":
        earned = F.when(kind == "retirement", "their judicial service").otherwise(text("their ", role, court))
        lines = [F.lit(wordings.REVIEW_NOTE), F.lit(""), text(organisation, " congratulates ", name, " on ", earned, "."), text("We wish ", name, " every success and continued contribution to the administration of justice", country, "."), F.lit(""), F.lit("Human review required before posting.")]
    elif output == "Short executive note":
        subject = text("Judicial movement note: ", name)
        lines = [F.lit(wordings.REVIEW_NOTE), F.lit(""), text(name, " has been identified from source reporting for ", F.replace(kind, F.lit("_"), F.lit(" ")), ": ", role, court, "."), F.lit("Recommended action: review details against the original source before any congratulatory outreach.")]
    else:
        wish = wordings.TONES.get(tone, wordings.TONES["Formal judiciary"])
        greeting = F.replace(F.lit(wish), F.lit("this important appointment"), text("your appointment as ", role, court))
        success = text("We wish you every success in this important role and look forward to following your continued contribution to the administration of justice", country, ".")
        lines = [F.lit(wordings.REVIEW_NOTE), F.lit(""), text("Dear ", name, ","), F.lit(""), text(f"On behalf of {organisation}, ", greeting), F.lit(""), F.lit(""), success, F.lit(""), F.lit("Yours sincerely,"), F.lit(sender)]
    return movements.withColumns({"subject": subject, "body": F.concat_ws("\n", *lines), "missing": missing, "can_approve": F.size(missing) == 0})
