"""Personal data and secrets: patterns propose spans, checksums confirm, context adjusts.

Spark has no function that returns the positions of all matches, but ``split``
(what lies between the matches) and ``regexp_extract_all`` (the matches) walk a
text with the same matcher; the running sums of their lengths are the positions.

The patterns are written so that a match never has to be sought twice from
inside one run of characters (lookbehind or the end of the match before, then
possessive quantifiers or bounds), which keeps them linear on very long runs and
selects the same leftmost matches. An account number ends at the length of its
country, whatever follows.

A span's score is the prior of its form, more if words of its kind stand within
``CONTEXT_CHARS`` on either side (up to the next match of the kind), less if words there say that it is a mere
example. Spans of the base kinds stay whatever their score. An added one needs ``KEEP_SCORE``: forms
with a prior below it (account numbers of unregistered countries, national ids, long
mixed strings) stay only with context, and an example loses all but the plainest.

Defined cases: null text counts as empty and has no spans; ids may be null or
repeat, each row is treated by itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.arrays import running_sum

# The base kinds in their order, then what this method adds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ipv6", "national_id", "secret")

#: Lengths of account numbers by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_COUNTRIES = "|".join(c for names in IBAN_LENGTHS.values() for c in names.split())
_BY_LENGTH = "|".join(rf"(?:{names.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in IBAN_LENGTHS.items())

_GROUP = "[0-9A-Fa-f]{1,4}"
#: Keys whose form gives them away, assignments to telling names, and long mixed strings.
_KEY = (
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{36,}+|github_pat_[A-Za-z0-9_]{40,}+|xox[abprs]-[A-Za-z0-9-]{10,}+"
    r"|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
)
_ASSIGNED = (
    r"(?<![A-Za-z0-9])(?i:[a-z0-9]{0,20}[_-])?(?i:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|secret[_-]?key)"
    r"[\"']? {0,2}[:=] {0,2}(?:\"[^\"\s]{6,}+\"|'[^'\s]{6,}+'|[^\s\"',;]{6,}+)"
)
_MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]{0,60}[0-9])(?=[0-9+/_-]{0,60}[A-Za-z])[A-Za-z0-9+/_-]{20,}+"

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?:{_BY_LENGTH}|(?!{_COUNTRIES})[A-Z]{{2}}[0-9]{{2}}(?:(?! (?:{_COUNTRIES})[0-9]{{2}}) ?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}(?::{_GROUP}){{0,5}})?::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![0-9A-Za-z:])",
    "national_id": r"(?<![0-9A-Za-z-])(?:(?!000|666|9)[0-9]{3}([- ])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}|[A-CEGHJ-PR-TW-Z]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D])(?![0-9A-Za-z-])",
    "secret": f"{_KEY}|{_ASSIGNED}|{_MIXED}",
}
#: A cheap test that every text with a match passes.
HINTS = {"email": "@", "phone": "+"}
HINT_PATTERNS = {
    "ip": r"[0-9]\.[0-9]",
    "card": r"[0-9](?:[ -]?[0-9]){15}",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11}",
    "ipv6": r"[0-9A-Fa-f:]:[0-9A-Fa-f:]",
    "national_id": r"[0-9]{2}[- ]?[0-9]{2}[- ]?[0-9]{2}",
}
#: Of secrets each test begins with a rare character, which one pattern of them all wouldn't: a digit beside a letter or sign,
#: an assignment to what ends as the names do, what follows a prefix, keys without digits.
SECRET_HINTS = (
    r"[0-9](?:[A-Za-z+/_-]|(?<=[A-Za-z+/_-][0-9]))", r"[:=](?<=[dDeEtTnNyY][\"']{0,1} {0,2}[:=])", r"[_-][A-Za-z0-9_-]{10}", r"A[KSGIRN][IPDOA]A[A-Z0-9]{16}", "-----BEGIN", "eyJ", "AIza",
)
#: Words that speak for a kind when they stand near the span.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|credit|debit|payment|pay)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|cell)\b",
    "iban": r"(?i)\b(?:iban|bank|account|transfer|konto)\b",
    "ipv6": r"(?i)\b(?:ip|ipv6|host|server|address|login|from)\b",
    "national_id": r"(?i)\b(?:ssn|social security|national insurance|nino|identity|id number)\b",
    "secret": r"(?i)\b(?:password|passwd|secret|token|key|credentials?|bearer|authorization|login)\b",
}
#: Words that speak against any kind.
AGAINST = r"(?i)\b(?:example|sample|dummy|placeholder|fake|redacted|checksum|sha1|sha256|md5|commit|isbn)\b"
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.7, "ipv6": 0.6, "national_id": 0.4}
#: An account number of a country that isn't registered has only its checksum for it: it needs context.
PRIOR_UNREGISTERED = 0.4
#: Of a secret: a known form, an assigned value with a digit, another assigned value, a mixed string.
PRIOR_KEY, PRIOR_ASSIGNED, PRIOR_WORD, PRIOR_MIXED = 0.9, 0.75, 0.3, 0.35
CONTEXT_CHARS, CONTEXT_WEIGHT, AGAINST_WEIGHT, KEEP_SCORE = 40, 0.2, 0.3, 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""
    chars = F.split(F.reverse(digits), "")

    def add(acc: Column, i: Column) -> Column:
        d = F.get(chars, i).cast("int")
        twice = d * 2
        return acc + F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an account number (blanks allowed) passes the mod-97 checksum."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        value = F.when(c <= "9", c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
        return F.when(F.length(value) == 1, acc * 10 + value.cast("int")).otherwise(acc * 100 + value.cast("int")) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _ip_parts_fit(s: Column) -> Column:
    def fits(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+(?=.)", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(s, r"\."), fits)


def _confirmed(kind: str, s: Column) -> Column:
    if kind == "ip":
        return _ip_parts_fit(s)
    if kind == "card":
        return F.when(F.length(_digits(s)).between(16, 19), luhn(_digits(s))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    if kind == "iban":
        return mod97(s)
    if kind == "ipv6":  # not the scope of a name, as in a::b
        return F.regexp_like(s, F.lit("[0-9]")) & (F.size(F.filter(F.split(s, ":"), lambda x: x != "")) >= 3)
    return F.lit(True)


def _prior(kind: str, m: Column) -> Column:
    """What the form of a match is worth before its context."""
    if kind == "iban":
        return F.when(F.substring(m, 1, 2).isin(*_COUNTRIES.split("|")), PRIOR[kind]).otherwise(PRIOR_UNREGISTERED)
    if kind == "secret":
        named = F.regexp_like(m, F.lit(f"^(?:{_ASSIGNED})$"))
        digit = F.regexp_like(m, F.lit("[:=].*[0-9]"))
        return F.when(F.regexp_like(m, F.lit(f"^(?:{_KEY})$")), PRIOR_KEY).when(named & digit, PRIOR_ASSIGNED).when(named, PRIOR_WORD).otherwise(PRIOR_MIXED)
    return F.lit(PRIOR[kind])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, text``, the columns ``keep``, and ``spans``.

    ``spans``: array of ``kind, start, end, score`` (code points, end exclusive),
    by kind in the order of ``KINDS``, then by start. Spans of the base kinds
    stay whatever their score; an added kind needs ``KEEP_SCORE``.
    """
    own = {c: f"__keep_{i}" for i, c in enumerate(keep)}
    df = docs.select(
        F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"), *(F.col(c).alias(n) for c, n in own.items())
    )
    carried = ["__id", "__text", *own.values()]
    text = F.col("__text")
    none = F.array().cast("array<string>")

    def likely(kind: str) -> Column:
        if kind == "secret":
            return reduce(Column.__or__, (F.regexp_like(text, F.lit(h)) for h in SECRET_HINTS))
        return F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.regexp_like(text, F.lit(HINT_PATTERNS[kind]))

    # 1. matches and gaps; each column is computed once, as later steps use it more than once
    df = df.select(*carried, *(F.when(likely(k), F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in KINDS))
    df = df.select(
        *carried,
        *(F.col(f"m_{k}") for k in KINDS),
        *(F.when(F.size(f"m_{k}") > 0, F.split(text, PATTERNS[k], -1)).otherwise(none).alias(f"g_{k}") for k in KINDS),
    )

    # 2. positions
    def steps(kind: str) -> Column:
        return F.transform(f"m_{kind}", lambda m, i: (F.length(m) + F.length(F.get(F.col(f"g_{kind}"), i))).cast("bigint"))

    df = df.select(
        *carried,
        *(F.col(f"{p}_{k}") for p in "mg" for k in KINDS),
        *(running_sum(steps(k)).alias(f"e_{k}") for k in KINDS),
    )

    # 3. checks, context, score
    def spans_of(kind: str) -> Column:
        def at(m: Column, i: Column) -> Column:
            gaps = F.col(f"g_{kind}")
            around = F.concat(F.right(F.get(gaps, i), F.lit(CONTEXT_CHARS)), F.lit("\n"), F.left(F.coalesce(F.get(gaps, i + 1), F.lit("")), F.lit(CONTEXT_CHARS)))
            score = (
                _prior(kind, m)
                + F.when(F.regexp_like(around, F.lit(CONTEXT[kind])), CONTEXT_WEIGHT).otherwise(0.0)
                - F.when(F.regexp_like(around, F.lit(AGAINST)), AGAINST_WEIGHT).otherwise(0.0)
            )
            end = F.get(F.col(f"e_{kind}"), i)
            return F.struct(
                F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), F.round(score, 2).alias("score"), _confirmed(kind, m).alias("ok")
            )

        kept = F.filter(F.transform(f"m_{kind}", at), lambda s: s["ok"])
        if kind not in BASE_KINDS:
            kept = F.filter(kept, lambda s: s["score"] >= KEEP_SCORE)
        return F.transform(kept, lambda s: F.struct(s["kind"], s["start"], s["end"], s["score"]))

    return df.select(
        F.col("__id").alias(id_col),
        F.col("__text").alias(text_col),
        *(F.col(n).alias(c) for c, n in own.items()),
        F.concat(*(spans_of(k) for k in KINDS)).alias("spans"),
    )


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, their digest, all spans as a string; then the number of all spans, counts of the added kinds, and the spans' scores as a string."""
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        F.col(id_col), *(count(k) for k in BASE_KINDS), F.sha2(_spelled(base), 256).alias("base_sha256"), _spelled(spans).alias("spans"),
        F.size(spans).cast("bigint").alias("n_spans"), *(count(k) for k in KINDS[len(BASE_KINDS) :]),
        F.array_join(F.transform(spans, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """``text_col`` with each span replaced by ``<KIND>``; overlapping spans become one, named after the first.

    Spans are merged in order of position; the text is cut as UTF-32, so the cost is linear.
    """
    columns = found.columns
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("far"), s["kind"].alias("kind"))))
    df = found.withColumn("__s", ordered)
    # furthest end so far, by doubling as in running_sum
    passes = F.when(F.size("__s") < 2, F.array().cast("array<int>")).otherwise(
        F.sequence(F.lit(0), F.ceil(F.log2(F.size("__s").cast("double"))).cast("int"))
    )
    reach = F.aggregate(
        passes,
        F.transform("__s", lambda s: -s["far"]),
        lambda acc, j: F.transform(acc, lambda x, i: F.greatest(x, F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), j)), F.lit(0).cast("bigint")))),
    )
    df = df.withColumn("__r", reach)
    # a span opens a masked run if it starts at or after all that came before
    df = df.withColumn(
        "__o",
        F.filter(
            F.transform(
                "__s",
                lambda s, i: F.struct(
                    s["start"].alias("start"), s["kind"].alias("kind"), F.coalesce(F.get(F.col("__r"), i - 1), F.lit(0).cast("bigint")).alias("before")
                ),
            ),
            lambda s: s["start"] >= s["before"],
        ),
    )
    wide = F.encode(F.col(text_col), "UTF-32")
    cut = lambda a, b: F.decode(F.substring(wide, (a * 4 + 1).cast("int"), ((b - a) * 4).cast("int")), "UTF-32")
    masked = F.concat(
        F.array_join(F.transform("__o", lambda s: F.concat(cut(s["before"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))), ""),
        F.decode(F.substring(wide, (F.element_at("__r", -1) * 4 + 1).cast("int"), 2147483647), "UTF-32"),
    )
    return df.select(*(F.when(F.size("__s") > 0, masked).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in columns))
