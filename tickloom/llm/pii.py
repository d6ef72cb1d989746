"""Personal data by pattern, checksum and context, in DataFrame expressions only.

A regular expression proposes the spans of a kind, a validator (octet range, Luhn, mod-97,
digit count) confirms them, and words near a span adjust its score: those of its kind raise
it, those of other numbers lower it. Near is within CONTEXT_CHARS before or after; what stands
before the first of several spans in a row counts for all of them. The base kinds (email, ip, card, phone) are kept whatever their score; the kinds that the method
adds (iban, and phone numbers without a plus sign) need the score of their threshold.

Positions: split() by a pattern gives the pieces between its matches, regexp_extract_all the
matches; the running sum of both lengths gives each span in code points. Patterns are written
so that matching time is linear in the text: possessive where no other match can follow, and
not begun inside a run that an earlier start has already refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import quoted, unused

# Kinds in listed order, the patterns that define them.
BASE_KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL_PHONE = r"(?<![0-9A-Za-z+.-])0[0-9]{1,4}[\x20/-][0-9](?:[\x20-]?[0-9]){4,9}(?![0-9])"

#: kind: (base score, score that a span needs, whole words that raise it, whole words that lower it)
KINDS = {
    "email": (0.9, 0.0, "(?:e-?)?mails?|contact|write", "example"),
    "ip": (0.6, 0.0, "ips?|hosts?|servers?|address(?:es)?", "versions?|release|chapter|section"),
    "card": (0.8, 0.0, "cards?|visa|mastercard|credit|payment", "orders?|invoice|serial|isbn|tracking"),
    "phone": (0.7, 0.0, "phones?|tel|call|mobile|fax|telefon", "orders?|invoice|serial"),
    "iban": (0.9, 0.5, "ibans?|accounts?|bank|konto", "serial|part|model"),
    "local_phone": (0.3, 0.6, "phones?|tel|call|mobile|fax|telefon", "orders?|invoice|serial|isbn|versions?"),
}
CONTEXT_BONUS, CONTEXT_MALUS = 0.4, 0.3
CONTEXT_CHARS = 40


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the string of digits passes the Luhn check."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number, its first four characters moved to the end, is 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""), F.lit(0), lambda a, ch: F.when(ch.rlike("[0-9]"), (a * 10 + F.ascii(ch) - 48) % 97).otherwise((a * 100 + F.ascii(ch) - 55) % 97)
    )
    return rest == 1


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$")
    if kind == "card":
        digits = _digits(s)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(10, 15)
    if kind == "local_phone":
        return F.length(_digits(s)).between(8, 13)
    if kind == "iban":
        return F.when(F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34), mod97(s)).otherwise(False)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str, worth: Column) -> Column:
    """array<struct<start, stop, rank, kind, found>> of the pattern's valid matches; rank orders kinds."""
    rank = list(KINDS).index(kind)
    none = F.array().cast("array<struct<start:int,stop:int,rank:int,kind:string,score:double>>")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    score, needed, raising, lowering = KINDS[kind]
    said = lambda gap, words: gap.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")
    none_said = F.lit(False)

    def step(a: Column, x: Column) -> Column:
        before, after = F.right(x["gap"], F.lit(CONTEXT_CHARS)), F.left(x["after"], F.lit(CONTEXT_CHARS))
        row = F.length(x["gap"]) < CONTEXT_CHARS  # close to the span before: what told of that tells of this one
        more = said(before, raising) | (row & a["more"])
        less = said(before, lowering) | (row & a["less"])
        start = a["at"] + F.length(x["gap"])
        worth_it = score + F.when(more | said(after, raising), CONTEXT_BONUS).otherwise(0.0) - F.when(less | said(after, lowering), CONTEXT_MALUS).otherwise(0.0)
        span = F.struct(
            start.alias("start"), (start + F.length(x["match"])).alias("stop"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), worth_it)).alias("score"),
        )
        return F.struct(
            (start + F.length(x["match"])).alias("at"), more.alias("more"), less.alias("less"), F.when(_valid(kind, x["match"]), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out")
        )

    gaps = F.arrays_zip(found.alias("match"), F.slice(between, 1, F.size(found)).alias("gap"), F.slice(between, 2, F.size(found)).alias("after"))
    walked = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), none_said.alias("more"), none_said.alias("less"), none.alias("out")), step)["out"]
    kept = F.filter(walked, lambda x: x["score"] >= needed) if needed else walked
    return F.when(worth, kept).otherwise(none)


def find_spans(df: DataFrame, *, text: str = "text", into: str = "pii") -> DataFrame:
    """df with `into`: array of struct(start, stop, rank, kind, score), by start then kind.

    A null or empty text has none. Spans of one kind never overlap; spans of two kinds may.
    Repeated rows stay; a column of the name `into` is replaced. Time is linear in the text but
    for the spans of one kind in one text, which are copied as they are gathered.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    arrays = [
        _spans(body, "email", EMAIL, F.contains(body, F.lit("@"))),
        _spans(body, "ip", IP, body.rlike(r"\.[0-9]")),
        _spans(body, "card", CARD, body.rlike(r"[0-9][\x20-]?[0-9]")),
        _spans(body, "phone", PHONE, F.contains(body, F.lit("+"))),
        _spans(body, "iban", IBAN, body.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]")),
        _spans(body, "local_phone", LOCAL_PHONE, body.rlike(r"0[0-9]{1,4}[\x20/-][0-9]")),
    ]
    return df.withColumn(into, F.array_sort(F.flatten(F.array(*arrays))))


def digest(df: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, max_score.

    Null and empty texts have no spans (max_score null); repeated and null keys keep their
    rows; texts of any length are searched whole. Other columns are not looked at.
    """
    found = find_spans(df.select(quoted(key).alias("doc_id"), quoted(text).alias("text")))
    base = F.filter("pii", lambda x: x["rank"] < len(BASE_KINDS))
    told = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", "pii").select(
        "doc_id",
        *[count(k) for k in BASE_KINDS],
        F.sha2(told(base).cast("binary"), 256).alias("base_sha256"),
        told(F.col("pii")).alias("spans"),
        F.array_max(F.transform("pii", lambda x: x["score"])).alias("max_score"),
    )


def redact(df: DataFrame, *, text: str = "text") -> DataFrame:
    """df with the text's spans replaced by [kind]; of overlapping spans the first by start, then kind, counts.

    A null text stays null. The columns are df's own, whatever their names.
    """
    held = unused(df, "spans")
    found = find_spans(df, text=text, into=held)
    body = F.coalesce(quoted(text), F.lit(""))
    walked = F.aggregate(
        held,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct(x["stop"].alias("at"), F.concat(a["out"], F.substr(body, a["at"] + 1, x["start"] - a["at"]), F.lit("["), x["kind"], F.lit("]")).alias("out")),
        ).otherwise(a),
    )
    whole = F.transform(F.array(walked), lambda w: F.concat(w["out"], F.substr(body, w["at"] + 1)))[0]
    return found.withColumn(text, F.when(quoted(text).isNotNull(), whole)).drop(held)
