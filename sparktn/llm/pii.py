"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

Every expression is written so that each start is tried once and nothing is matched twice over, in the order
that the plain expression has; positions are sums of the lengths of matches and of what lies between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that a contract fixes, with the expressions that propose them. Possessive forms of
#: [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
#: [0-9]([\x20-]?[0-9])+ and \+[0-9][\x20().0-9-]+[0-9] with the same leftmost matches.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "phone": "+"}
#: What a base kind's checks are worth, the words nearby that add to it and those that speak against it. Base spans stay whatever their score.
BASE_SCORES = {
    "email": (0.8, r"\b(e-?mail|contact|write to|mailto)\b", r"\b(example|placeholder)\b"),
    "ip": (0.5, r"\b(ip|host|server|address|login|client)\b", r"\b(version|release|section|chapter)\b"),
    "card": (0.8, r"\b(card|visa|mastercard|credit|payment)\b", r"\b(order|invoice|serial|isbn|tracking)\b"),
    "phone": (0.6, r"\b(phone|call|tel|mobile|fax)\b", r"\b(version|score|range)\b"),
}
#: Published forms of access keys and tokens, each of which tells its issuer, and runs of hexadecimal digits as long as a key's.
ISSUED = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+"
#: Kinds that the method adds, the validator's part of the score and what words nearby add.
EXTRA = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?: ?[A-Z0-9]){11,30}+[A-Za-z0-9]?))", 0.7, r"\b(iban|account|bank|konto|compte|cuenta)\b"),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3, r"\b(ssn|social|security|taxpayer)\b"),
    "secret": (rf"(?<![A-Za-z0-9_-])(?:{ISSUED}|[A-Fa-f0-9]{{32,128}}+)(?![A-Za-z0-9_-])", 0.3, r"(token|secret|password|passwd|credential|bearer|private.?key|(api|access).?key)"),
}
#: An IBAN's expression takes its first four characters only, so that each start is tried; what may follow is its group.
#: Lengths that the registry of IBANs fixes by country.
IBAN_LENGTHS = {k: int(n) for k, n in (x.split(":") for x in (
    "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BI:27 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DJ:27 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FK:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 "
    "GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MN:20 MR:27 MT:31 MU:30 NI:28 NL:18 NO:15 "
    "OM:23 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 RU:33 SA:24 SC:31 SD:18 SE:24 SI:19 SK:24 SM:27 SO:23 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20 YE:30").split())}  # fmt: skip
NEARBY, CONTEXT, LEAST = 40, 0.3, 0.5
BLOCK = 256
SPAN = "array<struct<kind:string,start:bigint,stop:bigint,score:double>>"


def placed(text: Column, hits: Column, gaps: Column) -> Column:
    """(start, stop, hit) of each match. Sums run within blocks and over blocks, so many matches stay cheap."""
    n = F.size(hits)
    cells = F.zip_with(F.slice(gaps, 1, n), hits, lambda g, h: F.struct(F.length(g).cast("bigint").alias("g"), F.length(h).cast("bigint").alias("m"), h.alias("h")))
    blocks = F.transform(F.sequence(F.lit(0), n - 1, F.lit(BLOCK)), lambda b: F.slice(cells, b + 1, F.lit(BLOCK)))
    nothing = F.array().cast("array<struct<start:bigint,stop:bigint,h:string>>")

    def inner(base: Column, cells: Column) -> Column:
        start = F.struct(base.alias("at"), nothing.alias("all"))
        return F.aggregate(cells, start, lambda a, x: F.struct((a["at"] + x["g"] + x["m"]).alias("at"), F.concat(a["all"], F.array(F.struct((a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["m"]).alias("stop"), x["h"].alias("h")))).alias("all")), lambda a: a["all"])

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, x: a + x["g"] + x["m"]))
    bases = F.aggregate(totals, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    return F.when(n > 0, F.flatten(F.zip_with(F.slice(bases, 1, F.size(blocks)), blocks, inner))).otherwise(nothing)


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def mod_97(code: Column) -> Column:
    """The remainder of an IBAN: its first four characters go last, letters count from 10."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) >= 65, 55).otherwise(48)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(F.pmod(a * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97))))


def valid(kind: str, h: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(h, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.when(F.length(part(p)) <= 3, part(p)).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits(h)).between(16, 19) & F.call_function("luhn_check", digits(h))
    if kind == "phone":
        return F.length(digits(h)).between(8, 15)
    if kind == "iban":
        code = F.replace(h, F.lit(" "), F.lit(""))
        return F.length(code).between(15, 34) & (mod_97(code) == 1)
    if kind == "secret":
        return F.rlike(h, F.lit("[0-9]")) & F.rlike(h, F.lit("[A-Za-z]"))
    return F.lit(True)


def iban(proposed: Column) -> Column:
    """The part of a proposed text, to the end of one of its groups, that is an IBAN, or an empty text.

    Of several, that of the country's length, or else the longest.
    """
    groups = F.split(proposed, " ")
    code = lambda h: F.replace(h, F.lit(" "), F.lit(""))
    parts = F.filter(F.transform(F.sequence(F.size(groups), F.lit(1)), lambda k: F.array_join(F.slice(groups, 1, k), " ")), lambda h: F.rlike(h, F.lit("^[A-Z0-9 ]+$")) & valid("iban", h))
    fixed = F.create_map(*(F.lit(x) for kv in IBAN_LENGTHS.items() for x in kv))
    sized = F.filter(parts, lambda h: F.length(code(h)) == F.try_element_at(fixed, F.substring(h, 1, 2)))
    return F.coalesce(F.get(F.concat(sized, parts), F.lit(0)), F.lit(""))


def apart(spans: Column) -> Column:
    """The spans that begin behind the one kept before."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint,h:string>>").alias("all"))
    return F.aggregate(spans, start, lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["stop"].alias("at"), F.concat(a["all"], F.array(s)).alias("all"))).otherwise(a), lambda a: a["all"])


def check(kind: str):
    return lambda h: valid(kind, h)


def of_kind(kind: str):
    return lambda s: s["kind"] == kind


def found(docs: DataFrame, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and spans: (kind, start, stop, score), of every row, base kinds as the contract has them first."""
    kinds = {k: r for k, r in BASE.items()} | {k: r for k, (r, _, _) in EXTRA.items()}
    df = docs.select(*keep, F.coalesce(F.col(column), F.lit("")).alias("__t"))
    t = F.col("__t")
    none = F.array().cast("array<string>")
    # a kind's proposals, and what lies between them only where there are any
    df = df.select("*", *(F.when(F.contains(t, F.lit(NEEDS[k])), F.regexp_extract_all(t, F.lit(r), F.lit(0))).otherwise(none).alias(f"__h_{k}") if k in NEEDS else F.regexp_extract_all(t, F.lit(r), F.lit(0)).alias(f"__h_{k}") for k, r in kinds.items()))
    heads, tails = F.col("__h_iban"), F.regexp_extract_all(t, F.lit(EXTRA["iban"][0]), F.lit(1))
    df = df.select("*", F.when(F.size(heads) > 0, F.transform(F.zip_with(heads, tails, lambda a, b: F.concat(a, b)), iban)).otherwise(none).alias("__i"))
    any_of = lambda k: F.exists("__i", lambda h: h != "") if k == "iban" else F.exists(F.col(f"__h_{k}"), check(k))
    df = df.select("*", *(F.when(any_of(k), F.split(t, r, -1)).otherwise(none).alias(f"__g_{k}") for k, r in kinds.items()))
    df = df.select("*", *(F.when(F.size(f"__g_{k}") > 0, placed(t, F.col(f"__h_{k}"), F.col(f"__g_{k}"))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint,h:string>>")).alias(f"__s_{k}") for k in kinds))
    long = F.zip_with("__s_iban", "__i", lambda s, h: F.struct(s["start"].alias("start"), (s["start"] + F.length(h)).alias("stop"), h.alias("h")))
    df = df.withColumn("__s_iban", F.when(F.size("__s_iban") > 0, apart(F.filter(long, lambda s: s["h"] != ""))).otherwise(F.col("__s_iban")))

    def spans(k: str) -> Column:
        sure = F.col("__s_iban") if k == "iban" else F.filter(F.col(f"__s_{k}"), lambda s: valid(k, s["h"]))
        base, words, *against = BASE_SCORES[k] if k in BASE else EXTRA[k][1:]
        before = lambda s: F.substr(t, F.greatest(s["start"] + 1 - NEARBY, F.lit(1)).cast("int"), F.least(s["start"], F.lit(NEARBY)).cast("int"))
        after = lambda s: F.substr(t, (s["stop"] + 1).cast("int"), F.lit(NEARBY))
        near = lambda s: F.lower(F.concat(before(s), F.lit("\n"), after(s)))  # noqa: E731  without the span itself

        def score(s: Column) -> Column:
            worth = F.when(F.rlike(s["h"], F.lit(f"^(?:{ISSUED})$")), 0.8).otherwise(base) if k == "secret" else F.lit(base)
            for sign, found in ((CONTEXT, words), *((-CONTEXT, w) for w in against)):
                worth = worth + F.when(F.rlike(near(s), F.lit(found)), sign).otherwise(0.0)
            return F.round(F.least(F.lit(1.0), worth), 2)

        scored = F.transform(sure, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), score(s).cast("double").alias("score")))
        return scored if k in BASE else F.filter(scored, lambda s: s["score"] >= LEAST)

    return df.select(*keep, F.concat(*(spans(k) for k in kinds)).cast(SPAN).alias("spans"))


def pii(docs: DataFrame, column: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores for every row.

    Null texts count as empty; texts without personal data have counts of zero, an empty spans string and
    the digest of it. scores are those of the spans, in their order: what the kind's checks are worth and what the
    words nearby add or take; spans of added kinds are given from a score of LEAST. Long texts are searched whole.
    Repeated and null keys each give a row. An empty table gives no rows.
    """
    df = found(docs, column)
    joined = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return df.select(
        "doc_id", *(F.size(F.filter("spans", of_kind(k))).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.concat_ws(",", F.transform("spans", lambda x: x["score"].cast("string"))).alias("scores"),
    )
