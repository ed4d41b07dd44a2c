"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Everything is a column expression. Base kinds are email, ip, card (Luhn) and phone; the method adds
iban (mod 97), nir (French social security, 97 less the number modulo 97) and ssn (US social security, its
ranges). A span's score starts at a value per kind and moves with whole words of four languages within
``CONTEXT_CHARS`` code points before or after it. The score decides the verdict on a document and what is
redacted (``LEAST_SCORE``); it never removes a base span from the list.

Patterns are written so that each position is visited a bounded number of times: repetitions are
possessive and a match may only begin at the start of a run (or where the last match ended).

Defined cases: a null or empty text has no spans; repeated rows are scanned once each; spans of different
kinds may overlap, ties of start go in the order of the kinds; very long texts are scanned whole; other
columns, of whatever name, are ignored (or kept, in redaction); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_or_empty
from tickloom.llm.spans import listed, matches, of_kind, ordered, redacted, unmarked

BASE = ("email", "ip", "card", "phone")
#: Working columns, named so that a table's own columns do not clash with them.
OWN_TEXT, OWN_SPANS = "__pii_text", "__pii_spans"

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

NIR = r"[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"

CONTEXT_CHARS = 40
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "nir": 0.8, "ssn": 0.7}
#: From this score on a span makes its document one with personal data, and is redacted.
LEAST_SCORE = 0.5
#: Whole words, in English, French, German and Spanish, that raise the score of a span of each kind.
RAISE = {
    "email": ("mail", "email", "e-mail", "mailto", "contact", "write", "courriel", "contacter", "écrire", "kontakt", "schreiben", "correo", "contacto", "escribir"),
    "ip": ("ip", "host", "server", "address", "login", "client", "adresse", "serveur", "connexion", "rechner", "anmeldung", "servidor", "dirección"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "payment", "carte", "paiement", "karte", "kreditkarte", "zahlung", "tarjeta", "pago"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "téléphone", "appeler", "portable", "telefon", "anrufen", "handy", "teléfono", "llamar", "móvil"),
    "iban": ("iban", "bank", "account", "transfer", "compte", "banque", "virement", "konto", "überweisung", "cuenta", "banco"),
    "nir": ("nir", "social", "security", "sécurité", "sociale", "assuré", "vitale"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
#: Whole words that lower it.
LOWER = {
    "email": ("example", "noreply", "exemple", "beispiel", "ejemplo"),
    "ip": ("version", "release", "section", "chapter", "abschnitt", "chapitre", "sección", "versión"),
    "card": ("order", "tracking", "serial", "isbn", "commande", "bestellung", "pedido"),
    "phone": ("isbn", "serial", "order", "commande", "bestellung", "pedido"),
    "iban": ("serial", "part", "pièce", "teil", "pieza"),
    "nir": ("serial", "part", "order"),
    "ssn": ("serial", "part", "order", "isbn"),
}
RAISED_BY, LOWERED_BY = 0.1, 0.3


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = d * 2
        return acc + F.when(i % 2 == 1, F.when(doubled > 9, doubled - 9).otherwise(doubled)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN without spaces leaves 1 modulo 97, read from its fifth character on, letters as 10 to 35."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.substring(moved, i, F.lit(1))
        n = F.ascii(c)
        return F.when(n < 58, (acc * 10 + n - 48) % 97).otherwise((acc * 100 + n - 55) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


def nir_key(digits: Column) -> Column:
    """Whether the last two of 15 digits are 97 less the first 13 modulo 97."""
    return F.substring(digits, 1, 13).cast("long") % 97 + F.substring(digits, 14, 2).cast("int") == 97


def ssn_ranges(text: Column) -> Column:
    """Whether the three parts lie in the ranges that are given out."""
    area = F.substring(text, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(text, 5, 2) != "00") & (F.substring(text, 8, 4) != "0000")


def _alone(text: Column, span: Column) -> Column:
    """Whether no ASCII letter or digit touches the span."""
    before = F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise("")
    return ~F.concat(before, F.lit(" "), F.substring(text, span["end"] + 1, F.lit(1))).rlike("[A-Za-z0-9]")


def _octets(text: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) <= 3) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 255)

    return F.forall(F.split(text, r"\."), small)


def _card(text: Column) -> Column:
    digits = F.regexp_replace(text, "[ -]", "")
    return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)


def _any_word(words: tuple[str, ...]) -> str:
    """A whole one of the words: no letter, accent or number of any script touches it."""
    return r"(?<![\p{L}\p{M}\p{N}])(?:" + "|".join(words) + r")(?![\p{L}\p{M}\p{N}])"


def _score(text: Column, span: Column) -> Column:
    before = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    near = F.lower(
        F.concat(
            F.substring(text, before + 1, span["start"] - before), F.lit(" "), F.substring(text, span["end"] + 1, F.lit(CONTEXT_CHARS))
        )
    )
    base, up, down = F.lit(0.0), F.lit(False), F.lit(False)
    for kind, score in BASE_SCORE.items():
        own = span["kind"] == kind
        base = F.when(own, score).otherwise(base)
        up = F.when(own, near.rlike(_any_word(RAISE[kind]))).otherwise(up)
        down = F.when(own, near.rlike(_any_word(LOWER[kind]))).otherwise(down)
    return F.round(F.least(F.lit(1.0), base + F.when(up, RAISED_BY).otherwise(0.0)) - F.when(down, LOWERED_BY).otherwise(0.0), 2)


def scored_spans(raw: Column) -> Column:
    """Every span of an ``unmarked`` text as start, rank, end, kind, text, score, in order."""
    none = F.array().cast("array<struct<start:int,end:int,text:string>>")

    def plain(pattern: str, valid) -> Column:
        return F.filter(matches(raw, pattern), lambda s: _alone(raw, s) & valid(s["text"]))

    found = {
        "email": F.when(F.contains(raw, F.lit("@")), matches(raw, EMAIL)).otherwise(none),
        "ip": F.filter(matches(raw, IP), lambda s: _octets(s["text"])),
        "card": F.filter(matches(raw, CARD), lambda s: _card(s["text"])),
        "phone": F.when(
            F.contains(raw, F.lit("+")),
            F.filter(matches(raw, PHONE), lambda s: F.length(F.regexp_replace(s["text"], "[^0-9]", "")).between(9, 15)),
        ).otherwise(none),
        "iban": F.filter(matches(raw, IBAN), lambda s: mod97(F.replace(s["text"], F.lit(" "), F.lit("")))),
        "nir": plain(NIR, lambda t: nir_key(F.replace(t, F.lit(" "), F.lit("")))),
        "ssn": F.when(F.contains(raw, F.lit("-")), plain(SSN, ssn_ranges)).otherwise(none),
    }
    return F.transform(ordered(found), lambda s: s.withField("score", _score(raw, s)))


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``pii``: every span as start, rank, end, kind, text, score, in order."""
    return docs.select("doc_id", unmarked(text_or_empty()).alias("text")).select("doc_id", scored_spans(F.col("text")).alias("pii"))


def redact_pii(docs: DataFrame, mark: str = "[personal]", least: float = LEAST_SCORE) -> DataFrame:
    """The documents with every span of a score of ``least`` or more replaced by ``mark``; columns stay as they are."""
    marked = docs.withColumn(OWN_TEXT, unmarked(text_or_empty())).withColumn(OWN_SPANS, F.filter(scored_spans(F.col(OWN_TEXT)), lambda s: s["score"] >= least))
    text = F.when(F.size(OWN_SPANS) > 0, redacted(text_or_empty(), F.col(OWN_SPANS), mark)).otherwise(F.col("text"))
    return marked.withColumn("text", text).select(*docs.columns)


def pii_digests(docs: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans, all spans and their scores, and the verdict ``has_personal_data``."""
    spans = F.col("pii")
    return find_pii(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(of_kind(spans, k)).cast("long").alias(f"n_{k}") for k in BASE_SCORE],
        F.sha2(listed(of_kind(spans, *BASE)), 256).alias("base_sha256"),
        listed(spans).alias("spans"),
        F.array_join(F.transform(spans, lambda s: F.format_string("%.2f", s["score"])), ",").alias("scores"),
        F.exists(spans, lambda s: s["score"] >= LEAST_SCORE).alias("has_personal_data"),
    )
