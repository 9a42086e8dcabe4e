"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their scores.

DataFrame functions only. Matches come from regexp_extract_all, their places from the lengths of the text between them, which `split`
gives; context is at most REACH characters of that text on either side, so it ends at the neighbouring match of the kind.
The patterns are written so that a text of any length is read in linear time: possessive repeats, and a look-behind that
lets a match begin only where a run begins or the last match ended, which is where the plain pattern's leftmost matches begin.
An iban's end is not the pattern's to say, as words in capitals may follow: every place where one may begin is looked at, and
the length its country has, or else mod 97, says where it ends. (A space before the text keeps `split` from dropping an empty first part.)

Base kinds (email, ip, card, phone) are reported whenever their check holds; context only moves their score. Further kinds
(iban by mod 97, ssn by layout) are reported when their score reaches `least`, which an ssn does only beside a context word.

Defined cases. Null text: as empty, no spans. Null ids and repeated rows pass through, a row each. Empty table: empty
result. Input columns other than those named are dropped by `find` and kept by `redact`, whatever they are called."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The kinds in their order, with pattern and score before context.
KINDS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", 0.6),
    # Of no width: the group is all an iban from here might take, and a letter or digit that goes on after it.
    "iban": (r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))", 0.7),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.3),
}
BASE = ("email", "ip", "card", "phone")
CONTEXT = {
    "email": "mail|e-mail|email|contact|write|correo|courriel",
    "ip": "ip|address|host|server|login|adresse",
    "card": "card|visa|mastercard|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|telefon|appel",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer",
}
# Characters of an iban by country, as the registry lists them.
IBAN = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
BONUS, REACH = 0.3, 40
BLOCK = 512


def _holds(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        bare = F.regexp_replace(m, " ", "")
        turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
        step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
        return F.length(bare).between(15, 34) & (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1)
    return F.lit(True)


def _iban(m: Column) -> Column:
    """The iban that m begins with, or null: as long as its country says; of a country not listed, the longest that mod 97 confirms."""
    end = "(?![A-Za-z0-9])"
    listed_ = "|".join(rf"(?:{x.replace(' ', '|')})(?:\x20?[A-Z0-9]){{{n - 2}}}" for n, x in IBAN.items())
    known = F.array(F.regexp_extract(m, rf"^(?:{listed_}){end}", 0))
    other = F.array(*[F.regexp_extract(m, rf"^[A-Z0-9](?:\x20?[A-Z0-9]){{{n - 1}}}{end}", 0) for n in range(34, 14, -1)])
    ends = F.when(F.substring(m, 1, 2).isin(" ".join(IBAN.values()).split()), known).otherwise(other)
    return F.get(F.filter(ends, lambda x: _holds("iban", x)), F.lit(0))


def _bound(c: Column, use) -> Column:
    """use(c) with c worked out once, as a lambda's variable."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _walk(items: Column, state: Column, kind_of: str, step) -> Column:
    """What step(state, item) = (state, output) puts out for the items in turn, as an array.

    In blocks, as appending to one list of all outputs would copy it for each item."""
    empty = F.array().cast(f"array<{kind_of}>")

    def one(acc, x):
        after, out = step(acc["p"], x)
        return F.struct(after.alias("p"), F.concat(acc["o"], F.array(out)).alias("o"))

    def block(items, acc, i):
        part = F.aggregate(F.slice(items, i * BLOCK + 1, F.lit(BLOCK)), F.struct(acc["p"].alias("p"), empty.alias("o")), one)
        return _bound(part, lambda x: F.struct(x["p"].alias("p"), F.concat(acc["o"], F.array(x["o"])).alias("o")))

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int"))
    start = F.struct(state.alias("p"), F.array().cast(f"array<array<{kind_of}>>").alias("o"))
    return F.flatten(_bound(items, lambda z: F.aggregate(blocks, start, lambda acc, i: block(z, acc, i), lambda acc: acc["o"])))


def _items(m: Column, s: Column) -> Column:
    """Matches (m) with the text before (s) and after (n), up to the neighbouring matches."""
    return F.arrays_zip(m.alias("m"), F.slice(s, F.lit(1), F.size(m)).alias("s"), F.slice(s, F.lit(2), F.size(m)).alias("n"))


def _score(kind: str, x: Column, m: Column) -> Column:
    """Of match m with the surroundings of item x."""
    after = F.length(m) if kind == "iban" else F.lit(0)  # an iban begins the text after its match of no width
    near = F.lower(F.concat(F.substring(x["s"], F.lit(-REACH), F.lit(REACH)), F.lit(" "), F.substring(x["n"], after + 1, F.lit(REACH))))
    return F.least(F.lit(1.0), KINDS[kind][1] + F.when(near.rlike(rf"(?<![a-z])(?:{CONTEXT[kind]})(?![a-z])"), BONUS).otherwise(0.0))


def _confirmed(kind: str, x: Column, least: float) -> Column:
    """The match of item x that holds and scores enough, or null."""
    m = _iban(x["m"]) if kind == "iban" else F.when(_holds(kind, x["m"]), x["m"])
    return m if kind in BASE else _bound(m, lambda y: F.when(_score(kind, x, y) >= least, y))


def _spans(kind: str, least: float) -> Column:
    """Spans (start, rank, kind, end, score) of a kind from the columns m_<kind> and s_<kind>."""
    rank, m = list(KINDS).index(kind), F.col(f"m_{kind}")

    def step(p, x):
        a = p + F.length(x["s"])
        return a if kind == "iban" else a + F.length(x["m"]), F.struct(a.alias("a"), x["m"].alias("m"), x["s"].alias("s"), x["n"].alias("n"))

    placed = _walk(_items(m, F.col(f"s_{kind}")), F.lit(-1 if kind == "iban" else 0), "struct<a:int,m:string,s:string,n:string>", step)
    found = F.filter(F.transform(placed, lambda x: F.struct(x["a"].alias("a"), _confirmed(kind, x, least).alias("c"), x["s"].alias("s"), x["n"].alias("n"))), lambda x: x["c"].isNotNull())
    out = F.transform(found, lambda x: F.struct(x["a"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["a"] + F.length(x["c"])).alias("end"), _score(kind, x, x["c"]).alias("score")))
    return F.when(F.size(m) > 0, out).otherwise(F.array().cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>"))


def _hint(kind: str, text: Column) -> Column:
    """What a text must hold to have a match at all; cheaper than the pattern."""
    return {"email": text.contains("@"), "phone": text.contains("+"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "iban": text.rlike("[A-Z]{2}[0-9]{2}"), "ssn": text.rlike("[0-9]{3}-[0-9]{2}-")}[kind]


def _matches(kind: str, text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(KINDS[kind][0]), F.lit(int(kind == "iban")))
    return F.when(_hint(kind, text), found).otherwise(F.array().cast("array<string>"))


def _between(kind: str, text: Column, m: Column) -> Column:
    parts = F.split(F.concat(F.lit(" "), text) if kind == "iban" else text, KINDS[kind][0], -1)
    return F.when(F.size(m) > 0, parts).otherwise(F.array().cast("array<string>"))


def find(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """One row per row: doc_id, text (null: empty), spans array of (start, rank, kind, end, score) by start, then rank.

    Places count code points from 0, end exclusive. `keep`: a column of docs passed on as `kept`."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *([keep.alias("kept")] if keep is not None else []))
    cols = ["doc_id", "text", *(["kept"] if keep is not None else [])]
    df = df.select(*cols, *[_matches(k, F.col("text")).alias(f"m_{k}") for k in KINDS])
    df = df.select("*", *[_between(k, F.col("text"), F.col(f"m_{k}")).alias(f"s_{k}") for k in KINDS])
    return df.select(*cols, F.array_sort(F.concat(*[_spans(k, least) for k in KINDS])).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced by its kind in brackets, one kind after the other.

    A null text stays null. All columns are returned, in their order."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    for kind in KINDS:
        df = df.select("row", "text", _matches(kind, F.col("text")).alias("m"))
        df = df.select("row", "text", "m", _between(kind, F.col("text"), F.col("m")).alias("s"))
        df = df.select("row", F.when(F.size("m") > 0, _replaced(kind, least)).otherwise(F.col("text")).alias("text"))
    clean = F.when(F.col(f"row.`{text_col}`").isNotNull(), F.col("text"))
    return df.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def _replaced(kind: str, least: float) -> Column:
    """The text of the columns m and s with the confirmed matches replaced."""
    name, m, s = F.lit(f"[{kind.upper()}]"), F.col("m"), F.col("s")
    if kind != "iban":
        parts = F.flatten(F.transform(_items(m, s), lambda x: F.array(x["s"], F.when(_confirmed(kind, x, least).isNotNull(), name).otherwise(x["m"]))))
        return F.concat(F.array_join(parts, ""), F.element_at(s, -1))

    # An iban may run on over the places where further ones might begin: p counts its characters still to be left out.
    def step(p, x):
        said = F.when((p == 0) & x["c"].isNotNull(), name).otherwise("")
        gone = F.when((p == 0) & x["c"].isNotNull(), F.length(x["c"])).otherwise(p)
        return F.greatest(gone - F.length(x["n"]), F.lit(0)), F.concat(said, F.substring(x["n"], gone + 1, F.length(x["n"])))

    items = F.transform(_items(m, s), lambda x: F.struct(_confirmed(kind, x, least).alias("c"), x["n"].alias("n")))
    return F.concat(F.substring(F.get(s, F.lit(0)), F.lit(2), F.length(F.get(s, F.lit(0)))), F.array_join(_walk(items, F.lit(0), "string", step), ""))
