"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

Everything here is a Spark expression; no Python code sees a row. Positions are code points, end exclusive.
A pattern's matches are leftmost and do not overlap: the pieces between matches come from split(), the matches
from regexp_extract_all(), and running sums of their lengths give the positions. Possessive quantifiers and the
start condition `\\G or not inside a run` keep the work linear in texts of long runs and change no match. Arrays are
folded in stretches of STRETCH, as a fold copies what it has so far: work is about linear in the number of matches.

Besides the base kinds there are account numbers (iban, by mod-97), ssn, and secrets: values of at least 16 characters
that are assigned to a token, key or password, with a digit, a letter and eight different characters. Context is up to
CONTEXT_CHARS between a match and its neighbours of the same kind.

Edge cases: a null or empty text has no spans; repeated rows are each answered; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import table

EMAIL_RUN = "A-Za-z0-9._%+-"
SECRET = r"(?i)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']? {0,3}[:=] {0,3}[\"']?[a-z0-9+/_-]{16,}"
STRETCH = 256
#: kind -> (cheap condition that each match implies, pattern). Kinds in the order of their rank at equal starts.
PROPOSALS: dict[str, tuple[str, str]] = {
    "email": ("contains:@", rf"(?:\G|(?<![{EMAIL_RUN}]))[{EMAIL_RUN}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"(?:[0-9][ -]?){13}[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    "phone": ("contains:+", r"\+[0-9][ ().0-9-]+[0-9]"),
    "iban": (r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "secret": (r"[:=] {0,3}[\"']?[A-Za-z0-9+/_-]{16}", SECRET),
}
#: Of a match of such a kind only this part is the span.
PARTS = {"secret": "[A-Za-z0-9+/_-]+$"}
BASE = ("email", "ip", "card", "phone")
#: Score before context; spans of added kinds stay from THRESHOLD on, base ones always.
START_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "secret": 0.6}
THRESHOLD = 0.5
CONTEXT_CHARS = 40
RAISES = {
    "email": r"mail|contact|write|reach",
    "ip": r"\bip\b|address|server|host|login",
    "card": r"card|visa|mastercard|amex|credit|debit|payment",
    "phone": r"phone|call|tel\b|mobile|fax|cell",
    "iban": r"iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": r"ssn|social|security|tax",
    "secret": r"auth|credential|bearer|login",
}
LOWERS = {
    "email": r"example",
    "ip": r"version|release|section",
    "card": r"isbn|order|tracking|serial|invoice",
    "phone": r"order|serial|version",
    "iban": r"serial|order",
    "ssn": r"order|serial|part no",
    "secret": r"placeholder|dummy|checksum",
}

FOUND = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value being computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The array's running sums (or maxima), from that of no value, which is 0: one more than there are values.

    Stretches are folded apart, from where their predecessors end.
    """

    def folded(x: Column) -> Column:
        stretches = F.sequence(F.lit(0), F.ceil(F.size(x) / STRETCH).cast("int"))
        part = lambda k: F.slice(x, k * STRETCH + 1, F.lit(STRETCH))
        fold = lambda start, items: F.aggregate(items, F.array(start), lambda acc, v: F.concat(acc, F.array(combine(F.element_at(acc, -1), v))))
        alone = F.transform(stretches, lambda k: F.aggregate(part(k), F.lit(0), combine))
        begin = lambda starts: F.transform(stretches, lambda k: F.slice(fold(F.element_at(starts, k + 1), part(k)), F.lit(2), F.lit(STRETCH)))
        return _let(fold(F.lit(0), alone), lambda starts: F.concat(F.array(F.lit(0)), F.flatten(begin(starts))))

    return _let(values, folded)


def _located(text: Column, kind: str, hint: str, pattern: str) -> Column:
    """All matches with their places and what stands around them."""
    may = F.contains(text, F.lit(hint[9:])) if hint.startswith("contains:") else F.rlike(text, F.lit(hint))
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(g: Column, m: Column) -> Column:
        n = F.size(m)
        # The lengths of gap and match in turn; a running sum over them ends at each match.
        long = F.zip_with(F.slice(g, F.lit(1), n), m, lambda x, y: F.char_length(x) + F.char_length(y))
        ends = F.slice(_running(long, lambda a, v: a + v), F.lit(2), n)
        part = (lambda x: F.regexp_extract(x, PARTS[kind], 0)) if kind in PARTS else (lambda x: x)
        return F.transform(
            F.arrays_zip(ends.alias("end"), m.alias("match"), F.slice(g, F.lit(1), n).alias("before"), F.slice(g, F.lit(2), n).alias("after")),
            lambda x: _let(
                part(x["match"]),
                lambda own: F.struct(
                    (x["end"] - F.char_length(own)).alias("start"), x["end"].alias("end"), own.alias("match"),
                    F.right(x["before"], F.lit(CONTEXT_CHARS)).alias("before"), F.left(x["after"], F.lit(CONTEXT_CHARS)).alias("after"),
                ),
            ),
        )

    return F.when(may, _let(gaps, lambda g: _let(hits, lambda m: placed(g, m)))).otherwise(F.array().cast(FOUND))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's checksum."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1, F.try_divide(c.cast("int") * 2, F.lit(10)).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")),
    )
    return (F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10) == 0


def mod97(match: Column) -> Column:
    """Whether an account number, moved by four and with letters as 10 to 35, leaves 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(
        F.filter(turned, lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.rlike("^[0-9]$"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97),
    )
    return rest == 1


def confirmed(kind: str, match: Column) -> Column:
    """The validator of each kind."""
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.char_length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.char_length(_digits(match)).between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= 8)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9..)-|-00-|-0000$")
    return F.lit(True)


def _scored(kind: str, span: Column) -> Column:
    near = F.lower(F.concat(span["before"], F.lit(" "), span["after"]))
    up = F.when(near.rlike(RAISES[kind]), F.lit(0.2)).otherwise(F.lit(0.0))
    down = F.when(near.rlike(LOWERS[kind]), F.lit(0.2)).otherwise(F.lit(0.0))
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(START_SCORE[kind]) + up - down)), 3)


def _kept(found: Column, kind: str, rank: int) -> Column:
    """The confirmed spans among those found."""
    return F.transform(
        F.filter(found, lambda s: confirmed(kind, s["match"])),
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _scored(kind, s).alias("score")),
    )


def detect(frame: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Adds an array of spans (start, rank, end, kind, score), sorted; kinds may overlap one another.

    The base kinds stay at any score; the added kinds (iban, ssn, secret) stay from THRESHOLD on.
    """
    body = f"__{out}_text"
    frame = frame.withColumn(body, F.coalesce(F.col(text).cast("string"), F.lit("")))
    t = F.col(body)
    parts = []
    for rank, (kind, (hint, pattern)) in enumerate(PROPOSALS.items()):
        found, kept = f"__{out}_{kind}", f"__{out}_{kind}_kept"
        frame = frame.withColumn(found, _located(t, kind, hint, pattern))
        spans = _kept(F.col(found), kind, rank)
        if kind not in BASE:
            spans = F.filter(spans, lambda s: s["score"] >= THRESHOLD)
        frame = frame.withColumn(kept, F.when(F.size(F.col(found)) > 0, spans).otherwise(F.array().cast("array<struct<start:int,rank:int,end:int,kind:string,score:double>>"))).drop(found)
        parts.append(kept)
    return frame.withColumn(out, F.array_sort(F.concat(*parts))).drop(body, *parts)


def redact(frame: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """Replaces each span by its kind in angle brackets; of overlapping spans the first one names the gap."""
    body = F.coalesce(F.col(text), F.lit(""))

    def written(ends: Column) -> Column:
        """ends: how far the spans before each one reach, and at last all of them."""
        pieces = F.zip_with(F.slice(ends, F.lit(1), F.size(spans)), F.col(spans), lambda at, s: F.struct(at.alias("at"), s["start"].alias("start"), s["kind"].alias("kind")))
        pieces = F.filter(pieces, lambda p: p["start"] >= p["at"])
        return _let(pieces, lambda p: F.concat(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.size(p) / STRETCH).cast("int")), lambda k: stretch(F.slice(p, k * STRETCH + 1, F.lit(STRETCH))))), ""), F.substr(body, F.element_at(ends, -1) + 1, F.char_length(body))))

    def stretch(part: Column) -> Column:
        """What stands before each of some spans, and its kind; cut from their own stretch of the text."""
        first, last = F.get(part, F.lit(0))["at"], F.get(part, F.size(part) - 1)["start"]
        cut = lambda own: F.transform(part, lambda p: F.concat(F.substr(own, p["at"] - first + 1, p["start"] - p["at"]), F.lit("<"), F.upper(p["kind"]), F.lit(">")))
        return F.when(F.size(part) > 0, _let(F.substr(body, first + 1, last - first), cut)).otherwise(F.array().cast("array<string>"))

    done = _let(_running(F.transform(F.col(spans), lambda s: s["end"]), lambda a, v: F.greatest(a, v)), written)
    return frame.withColumn(text, F.when(F.size(F.col(spans)) > 0, done).otherwise(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = detect(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "pii")
    p = F.col("pii")
    count = lambda kind: F.size(F.filter(p, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(_listed(F.filter(p, lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _listed(p).alias("spans"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts with their personal data replaced."""
    names = docs.columns
    frame = redact(detect(docs, out="__pii"), spans="__pii")
    return frame.withColumn("n_chars", F.char_length("text").cast("long")).select(*names)


def _oracle() -> str:
    kinds = [
        ("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
        ("ip", 1, r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
        ("card", 2, r"[0-9](?:[ -]?[0-9])+"),
        ("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]"),
        ("secret", 6, SECRET.replace("'", "''")),
    ]
    each = " UNION ALL ".join(
        f"SELECT doc_id, '{k}' AS kind, {r} AS rnk, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')" for k, r, p in kinds
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS ({each}),
b AS (SELECT doc_id, kind, rnk, unnest(range(1, len(ms) + 1)) AS i, ms, gs FROM a),
c AS (SELECT doc_id, kind, rnk, i, ms[i] AS m, length(gs[i]) AS g, lower(right(gs[i], 40) || ' ' || left(gs[i + 1], 40)) AS near FROM b),
h AS (SELECT *, sum(g + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS fin, regexp_replace(m, '[^0-9]', '', 'g') AS dg FROM c),
e AS (SELECT * REPLACE (CASE WHEN kind = 'secret' THEN regexp_extract(m, '[A-Za-z0-9+/_-]+$') ELSE m END AS m) FROM h),
f AS (SELECT doc_id, kind, rnk, CAST(fin - length(m) AS BIGINT) AS st, CAST(fin AS BIGINT) AS fin FROM e WHERE
  CASE kind WHEN 'email' THEN true
    WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 8
      AND (NOT regexp_matches(near, 'placeholder|dummy|checksum') OR regexp_matches(near, 'auth|credential|bearer|login'))
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda x: NOT regexp_full_match(x, '0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])'))) = 0
    WHEN 'phone' THEN length(dg) BETWEEN 10 AND 15
    ELSE length(dg) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(dg) + 1), lambda i: CASE WHEN (length(dg) - i) % 2 = 0 THEN CAST(dg[i] AS INT) ELSE CAST(dg[i] AS INT) * 2 // 10 + CAST(dg[i] AS INT) * 2 % 10 END)) % 10 = 0 END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || st || ':' || fin, ',' ORDER BY st, rnk) FILTER (rnk < 4) AS s, string_agg(kind || ':' || st || ':' || fin, ',' ORDER BY st, rnk) AS every FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(every, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""


#: DuckDB's pattern language has no look-behind, so the SQL covers the base kinds and secrets; the tables hold no other.
ORACLE = _oracle()
