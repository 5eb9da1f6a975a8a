"""Normalisers as Column -> Column functions: null stays null, nothing is guessed.

Digits are ASCII digits. Money is integer cents, rounded half up; amounts of more than 32
digits are null. All of it runs inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPECIAL_SPACES = "    ​﻿"
#: Latin letters with marks and what remains of them without; NFKD forms of a few signs need
#: more than one character and are replaced one by one.
_MARKED = "ÀÁÂÃÄÅàáâãäåÈÉÊËèéêëÌÍÎÏìíîïÒÓÔÕÖòóôõöÙÚÛÜùúûüÇçÑñÝýÿªº"
_PLAIN = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyyao"
_EXPANDED = {"½": "1⁄2", "¼": "1⁄4", "¾": "3⁄4", "ﬁ": "fi", "ﬂ": "fl", "²": "2", "³": "3", "¹": "1"}
AMBIGUOUS_OCR = ("OILSZ", "01152")
#: Portuguese months by number.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")

Any = Column | str


def _c(x: Any) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body) -> Column:
    """``body`` of the value of ``x``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def _none_if_blank(x: Column) -> Column:
    return F.when(x != "", x)


def clean_spaces(x: Any) -> Column:
    """Special spaces become spaces, runs collapse, ends are trimmed; null gives the empty text."""
    plain = F.translate(F.coalesce(_c(x), F.lit("")), SPECIAL_SPACES, " " * len(SPECIAL_SPACES))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def digits(x: Any) -> Column:
    return F.regexp_replace(F.coalesce(_c(x), F.lit("")), "[^0-9]", "")


def strip_accents(x: Any) -> Column:
    """Marks of Latin letters fall; combining marks go."""
    out = F.translate(_c(x), _MARKED, _PLAIN)
    for sign, plain in _EXPANDED.items():
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.regexp_replace(out, r"\p{M}", "")


def _weighted(text: Column, weights: list[int]) -> Column:
    return sum((F.substring(text, i + 1, 1).cast("int") * w for i, w in enumerate(weights)), F.lit(0))


def _check_digit(total: Column) -> Column:
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


#: Weights of the two check digits of a company's tax number.
CNPJ_WEIGHTS = ([5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2], [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])


def cnpj_valid(x: Any) -> Column:
    """14 digits, not all alike, with both modulo-11 check digits right; null is false."""
    def test(d: Column) -> Column:
        good = ~d.rlike(r"^(\d)\1{13}$")
        for n, weights in zip((13, 14), CNPJ_WEIGHTS, strict=True):
            good = good & (let(_weighted(d, weights), _check_digit) == F.substring(d, n, 1).cast("int"))
        return F.when(F.length(d) == 14, good).otherwise(False)

    return let(digits(x), test)


def cnpj_with_check_digits(base12: Any) -> Column:
    """Twelve digits and the two check digits that they ask for."""
    digit = lambda weights: lambda b: F.concat(b, let(_weighted(b, weights), _check_digit).cast("string"))
    return let(let(_c(base12), digit(CNPJ_WEIGHTS[0])), digit(CNPJ_WEIGHTS[1]))


def normalize_cnpj(x: Any) -> Column:
    """struct(value, valid): the digits as read if the text is one number, or names just one."""
    text = clean_spaces(x)
    core = F.regexp_replace(text, r"[.\-/\s]", "")
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})"), F.lit(1)), lambda t: F.regexp_replace(t, r"\D", "")))
    value = F.when(core.rlike(r"^\d{14}$"), core).when(F.size(found) == 1, F.get(found, F.lit(0)))
    return let(value, lambda v: F.struct(v.alias("value"), cnpj_valid(v).alias("valid")))


def format_cnpj(x: Any) -> Column:
    return F.when(F.length(_c(x)) == 14, F.regexp_replace(_c(x), r"^(.{2})(.{3})(.{3})(.{4})(.{2})$", "$1.$2.$3/$4-$5")).otherwise(F.coalesce(_c(x), F.lit("")))


def key_check_digit(first43: Any) -> Column:
    """Check digit of an access key: weights 2 to 9 from the right, over and over."""
    return let(let(_c(first43), lambda b: _weighted(b, [2 + (42 - i) % 8 for i in range(43)])), _check_digit)


def access_key_valid(x: Any) -> Column:
    def test(d: Column) -> Column:
        good = ~d.rlike(r"^(\d)\1{43}$") & (key_check_digit(F.substring(d, 1, 43)) == F.substring(d, 44, 1).cast("int"))
        return F.when(F.length(d) == 44, good).otherwise(False)

    return let(digits(x), test)


def normalize_access_key(x: Any) -> Column:
    d = digits(x)
    value = F.when(F.length(d) == 44, d)
    return F.struct(value.alias("value"), access_key_valid(value).alias("valid"))


def key_parts(x: Any) -> Column:
    """struct(year, month, cnpj, number) that a key spells out; the month only if it is one."""
    k = F.when(F.length(digits(x)) == 44, digits(x))
    month = F.substring(k, 5, 2).cast("int")
    good = month.between(1, 12)
    return F.struct(F.when(good, 2000 + F.substring(k, 3, 2).cast("int")).alias("year"), F.when(good, month).alias("month"), F.substring(k, 7, 14).alias("cnpj"), F.substring(k, 26, 9).alias("number"))


def _year(x: Column) -> Column:
    n = x.try_cast("int")
    return F.when(F.length(x) == 4, n).when(F.length(x) == 2, F.when(n < 70, 2000 + n).otherwise(1900 + n))


def _month_number(x: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.substring(F.lower(strip_accents(x)), 1, 3)).cast("int")
    return F.when(at > 0, at)


def normalize_date(x: Any) -> Column:
    """struct(value, ambiguous): day-first or year-first numbers with one separator, or a day, a
    Portuguese month and a year. Ambiguous is a day-first number whose day could be a month."""
    numeric, spelled = r"^(\d{1,4})([/\-.])(\d{1,2})\2(\d{1,4})$", r"^(\d{1,2})\s*(?:de|do|d)?\s*(\p{L}+)\s*(?:de|do|d)?\s*(\d{2,4})$"

    def parts(text: Column) -> Column:
        part = lambda pattern, i: F.regexp_extract(text, pattern, i)
        return F.when(text.rlike(numeric), F.struct(F.lit(True).alias("n"), part(numeric, 1).alias("a"), part(numeric, 3).alias("b"), part(numeric, 4).alias("c"))).when(
            text.rlike(spelled), F.struct(F.lit(False).alias("n"), part(spelled, 1).alias("a"), part(spelled, 2).alias("b"), part(spelled, 3).alias("c"))
        )

    def numbers(p: Column) -> Column:
        year_first = p["n"] & (F.length(p["a"]) == 4)
        year = F.when(year_first, p["a"].try_cast("int")).otherwise(_year(p["c"]))
        month = F.when(p["n"], p["b"].try_cast("int")).otherwise(_month_number(p["b"]))
        day = F.when(year_first, p["c"]).otherwise(p["a"]).try_cast("int")
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), (p["n"] & ~year_first).alias("day_first"))

    def date(v: Column) -> Column:
        good = v["y"].between(1900, 2199) & v["m"].between(1, 12) & v["d"].between(1, 31)
        iso = F.concat_ws("-", v["y"].cast("string"), F.lpad(v["m"].cast("string"), 2, "0"), F.lpad(v["d"].cast("string"), 2, "0"))
        value = F.when(good, iso).try_cast("date")
        return F.struct(value.alias("value"), F.coalesce(value.isNotNull() & v["day_first"] & (v["d"] <= 12), F.lit(False)).alias("ambiguous"))

    return let(let(let(clean_spaces(x), parts), numbers), date)


def plausible_date(x: Any, reference: Any) -> Column:
    """Within 24 months before and 30 days after the reference; null is false."""
    return F.coalesce(_c(x).between(F.add_months(_c(reference), -24), F.date_add(_c(reference), 30)), F.lit(False))


def money_token(x: Any) -> Column:
    """The number of an amount, a minus sign before it if negative; null where anything else is left."""
    text = F.replace(F.regexp_replace(clean_spaces(x), r"(?i)(R\$|BRL|REAIS|REAL|\$)", ""), F.lit(" "), F.lit(""))
    shape = r"^([-+(]*)(\d[\d.,]*)([)\-]*)$"
    sign, number = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    return _none_if_blank(F.concat(F.when(sign.rlike(r"[-(]"), "-").otherwise(""), number))


def decimal_of_token(token: Any) -> Column:
    """The right-most of both separators is decimal; a lone comma is; dots before three digits group."""
    negative = F.substring(_c(token), 1, 1) == "-"
    s = F.regexp_replace(_c(token), "^-", "")
    count = lambda sep: F.length(s) - F.length(F.replace(s, F.lit(sep), F.lit("")))
    commas, dots = count(","), count(".")
    less = lambda sep: F.replace(s, F.lit(sep), F.lit(""))
    comma_last = F.instr(F.reverse(s), ",") < F.instr(F.reverse(s), ".")
    body = (
        F.when((commas > 0) & (dots > 0), F.when(comma_last, F.when(commas == 1, F.replace(less("."), F.lit(","), F.lit(".")))).otherwise(F.when(dots == 1, less(","))))
        .when(commas == 1, F.replace(s, F.lit(","), F.lit("."))).when(commas > 1, less(","))
        .when((dots >= 2) | s.rlike(r"^\d+\.\d{3}$"), less(".")).otherwise(s)
    )
    value = F.regexp_replace(body, r"\.$", "").try_cast("decimal(38,6)")
    return F.when(negative, -value).otherwise(value)


def money_cents(x: Any) -> Column:
    return F.round(let(money_token(x), decimal_of_token) * 100, 0).try_cast("bigint")


def money_format(x: Any) -> Column:
    s = F.regexp_replace(money_token(x), "^-", "")
    return (
        F.when(s.isNull(), "invalido").when(s.rlike(r"^\d{1,3}(,\d{3})+\.\d+$"), "us_milhar").when(s.rlike(r"^\d{1,3}(,\d{3}){2,}$"), "us_milhar")
        .when(s.rlike(r"^\d{1,3},\d{3}$"), "ambiguo_milhar").when(s.rlike(r"^\d{1,3}(\.\d{3})+(,\d+)?$"), "br_milhar")
        .when(s.rlike(r"^\d+,\d+$"), "br_decimal_virgula").when(s.rlike(r"^\d+(\.\d+)?$"), "br_inteiro").otherwise("invalido")
    )


def quantity(x: Any) -> Column:
    token = F.regexp_replace(F.regexp_extract(clean_spaces(x), r"(\d[\d.,]*)", 1), "[.,]+$", "")
    return decimal_of_token(_none_if_blank(token))


def quantity_text(q: Any) -> Column:
    """Without zeros that say nothing: 3.000 is 3, 3000 stays."""
    s = _c(q).cast("string")
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def quantity_and_unit(x: Any) -> Column:
    text = clean_spaces(x)
    rest = clean_spaces(F.regexp_replace(F.regexp_replace(text, r"^(\D*)\d[\d.,]*", "$1 "), r"^[ .,;:\-]+|[ .,;:\-]+$", ""))
    unit = F.substring(F.upper(rest), 1, 12)
    has = text.rlike(r"\d")
    return F.struct(quantity(x).alias("quantity"), F.when(has & unit.rlike(r"^[A-Z0-9º./]{1,12}$"), unit).alias("unit"))


def order_number(x: Any) -> Column:
    """The number without its label; leading zeros, slashes and dashes stay."""
    label = r"(?i)^\s*(?:n[ºo°]?\.?\s*|n[uú]mero\s+|pedido\s*(?:n[ºo°]?\.?\s*)?|nf-?e?\s*(?:n[ºo°]?\.?\s*)?|ordem\s*(?:de\s*)?(?:compra\s*)?|oc\s*|pc\s*)?[:#\-]?\s*"
    text = clean_spaces(F.regexp_replace(F.regexp_replace(clean_spaces(x), label, ""), r"^[ .,;:#\-]+|[ .,;:#\-]+$", ""))
    return F.when(text.rlike(r"^[A-Za-z0-9º°/.\- ]{1,40}$"), text)


#: Payment forms and the words that name them, in order; the first that fits counts.
PAYMENT_WORDS = (
    ("cartao_credito", r"cartao\s*de\s*credito|credito|\bcc\b"),
    ("cartao_debito", r"cartao\s*de\s*debito|debito"),
    ("pix", r"\bpix\b|pagamento\s+instant"),
    ("boleto", r"boleto|bloqueto"),
    ("transferencia", r"transferencia|\bted\b|\bdoc\b|deposito"),
    ("dinheiro", r"dinheiro|especie"),
    ("prazo", r"\bprazo\b|faturado|faturamento|\d+\s*dias"),
)
#: The same for text in OCR form, where pix and boleto come first.
PAYMENT_WORDS_READ = (
    ("pix", "PIX"), ("boleto", "BOLETO"), ("cartao_credito", r"CART[AÃ]O\s+DE\s+CR[EÉ]DITO|CR[EÉ]DITO"), ("cartao_debito", r"CART[AÃ]O\s+DE\s+D[EÉ]BITO|D[EÉ]BITO"),
    ("transferencia", r"TRANSFER[EÊ]NCIA|\bTED\b|\bDOC\b"), ("dinheiro", r"DINHEIRO|ESP[EÉ]CIE"), ("prazo", r"A\s+PRAZO|PRAZO|PARCELADO|FATURADO|30\s+DIAS|28\s+DIAS|15\s+DIAS"), ("outro", r"CART[AÃ]O"),
)


def payment_form(x: Any) -> Column:
    """Payment form that a free text names, outro if none, null if the text is blank."""
    named = lambda t: F.when(t != "", F.coalesce(*[F.when(t.rlike(p), F.lit(form)) for form, p in PAYMENT_WORDS], F.lit("outro")))
    return let(F.lower(strip_accents(clean_spaces(x))), named)


def ocr_pattern(pattern: str) -> str:
    """A pattern for text in OCR form: its letters, but not its escapes, in that form too."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out += pattern[i : i + 2]
            i += 2
        else:
            out += pattern[i].upper().translate(str.maketrans(*AMBIGUOUS_OCR))
            i += 1
    return out


def payment_form_read(x: Any) -> Column:
    """Payment form of a field read from a document; null if it names none."""
    text = ocr_form(x)
    return F.coalesce(*[F.when(text.rlike(ocr_pattern(p)), F.lit(form)) for form, p in PAYMENT_WORDS_READ])


def format_brl(cents: Any) -> Column:
    """12345,67 without grouping; null gives the empty text."""
    c = F.abs(_c(cents))
    text = F.concat(F.when(_c(cents) < 0, "-").otherwise(""), F.floor(c / 100).cast("string"), F.lit(","), F.lpad((c % 100).cast("string"), 2, "0"))
    return F.coalesce(text, F.lit(""))


def brl_label(cents: Any) -> Column:
    return F.when(_c(cents).isNull(), "—").otherwise(F.concat(F.lit("R$ "), format_brl(cents)))


def percent_label(share: Any) -> Column:
    return F.when(_c(share).isNull(), "—").otherwise(F.concat(F.round(_c(share) * 100, 0).cast("int").cast("string"), F.lit("%")))


def normalized_text(x: Any) -> Column:
    return F.regexp_replace(F.lower(strip_accents(F.coalesce(_c(x), F.lit("")))), r"[^\p{L}\p{N}]", "")


def text_hash(x: Any) -> Column:
    """sha256 of the text's letters and digits, without marks and case."""
    return F.sha2(normalized_text(x), 256)


def ocr_form(x: Any) -> Column:
    """Upper case with characters that OCR confuses made one; positions stay."""
    return F.translate(F.upper(F.coalesce(_c(x), F.lit(""))), *AMBIGUOUS_OCR)


def recover_ocr_text(x: Any) -> Column:
    """Words of three letters or more that hold digits get their letters back; noise marks go."""
    marks = "“”‘’\"'`´*|«»"
    letters = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", ""))

    def word(w: Column) -> Column:
        back = F.when(w.rlike("[0-9]") & (letters(w) >= 3), F.translate(w, "0152", "OISZ")).otherwise(w)
        return F.when((letters(w) >= 3) & F.contains(back, F.lit("l")), F.replace(back, F.lit("l"), F.lit("I"))).otherwise(back)

    clean = clean_spaces(F.translate(_c(x), marks, " " * len(marks)))
    return F.array_join(F.transform(F.split(clean, " "), word), " ")


def simulated_ocr_confidence(x: Any) -> Column:
    """0.75 for text without easily confused characters down to 0.55; 0 for blank text."""
    used = F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), r"\s", "")
    n = F.length(used)
    odd = n - F.length(F.translate(used, "0O1LI5S2Z", ""))
    share = F.least(F.lit(1).cast("decimal(20,10)"), odd.cast("decimal(20,10)") / F.greatest(n, F.lit(1)) / F.lit("0.60").cast("decimal(3,2)"))
    score = F.lit("0.75").cast("decimal(20,10)") - F.lit("0.20").cast("decimal(20,10)") * share
    return F.when(n == 0, F.lit(0).cast("decimal(6,4)")).otherwise(F.round(score, 4).cast("decimal(6,4)"))


def epoch_iso(x: Any) -> Column:
    """ISO time in UTC of epoch seconds; the session's time zone plays no part."""
    seconds = F.trim(_c(x).cast("string")).try_cast("bigint")
    day, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    clock = F.concat_ws(":", *[F.lpad(v.cast("string"), 2, "0") for v in (F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)])
    good = seconds.between(-62135596800, 253402300799)
    return F.when(good, F.concat(F.date_add(F.lit("1970-01-01").cast("date"), F.when(good, day).otherwise(0)).cast("string"), F.lit("T"), clock, F.lit("+00:00")))


def mask(x: Any) -> Column:
    text = F.coalesce(_c(x), F.lit(""))
    return F.when(text == "", "").when(F.length(text) < 8, "****").otherwise(F.concat(F.lit("****"), F.right(text, F.lit(4))))


def age_days(opened: Any, now: Any) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_seconds(_c(now)) - F.unix_seconds(_c(opened))) / 86400)).cast("int")


def tolerant_cents(x: Any) -> Column:
    """Text with a comma is in reais, without one in cents."""
    return F.when(F.instr(_c(x), ",") > 0, money_cents(x)).otherwise(F.trim(_c(x)).try_cast("bigint"))


#: Media types by file suffix.
MEDIA_TYPES = {".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".webp": "image/webp", ".tif": "image/tiff", ".tiff": "image/tiff", ".bmp": "image/bmp", ".jsonl": "application/x-ndjson", ".json": "application/json"}
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff", ".bmp")


def suffix(path: Any) -> Column:
    return F.lower(F.regexp_extract(_c(path), r"(\.[^./\\]+)$", 1))


def media_type(path: Any) -> Column:
    pairs = [F.lit(v) for kv in MEDIA_TYPES.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), suffix(path)), F.lit("application/octet-stream"))


def same_number(a: Any, b: Any) -> Column:
    """Equal digit strings but for leading zeros; blank is equal to nothing."""
    x, y = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))
    return x.rlike(r"^\d+$") & y.rlike(r"^\d+$") & (F.regexp_replace(x, "^0+", "") == F.regexp_replace(y, "^0+", ""))


def iso_date(x: Any) -> Column:
    return F.substring(F.trim(_c(x)), 1, 10).try_cast("date")
