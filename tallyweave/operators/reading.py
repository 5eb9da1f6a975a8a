"""Fields and item lines of one document's text, read line by line in Arrow batches.

A line has its own text and its OCR form, which agree position by position. A field has a list
of labels in order of trust: the value is looked for on a line that holds the first label, then
the second and so on; only then on the first non-blank line after a label that ends its line.
One search of the whole document for a field's labels finds the few lines that are looked at.
"""

from __future__ import annotations

import datetime as dt
import re
from bisect import bisect_right
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Context, Decimal

import pyarrow as pa

from ..functions.scalars import AMBIGUOUS_OCR, ocr_pattern

#: Labels by field, most trusted first.
LABELS = {
    "total": (r"VALOR\s+TOTAL\s+DA\s+NOTA", r"VALOR\s+TOTAL\s+DO\s+DOCUMENTO", r"TOTAL\s+A\s+PAGAR", r"VALOR\s+TOTAL\s+GERAL", r"VALOR\s+TOTAL", r"TOTAL\s+GERAL", r"\bTOTAL\b", r"\bVALOR\b"),
    "key": (r"CHAVE\s+DE\s+ACESSO",),
    "cnpj": (r"CNPJ",),
    "issued": (r"DATA\s+D[AE]\s+EMISS[AÃ]O", r"EMISS[AÃ]O\s+EM", r"EMITID[OA]\s+EM", r"EMITIDA?\s+EM", r"EMISS[AÃ]O"),
    "due": (r"DATA\s+DE\s+VENCIMENTO", r"VENCIMENTO", r"VENCE\s+EM"),
    "number": (r"N[º°O]?\s*D[OE]\s*PEDIDO", r"PEDIDO\s*N[º°O]?", r"N[ÚU]MERO\s*D[OE]\s*PEDIDO", r"N[ÚU]MERO\s*DA\s*NF", r"N[ÚU]MERO\s*D[OA]\s*NOTA", r"NOTA\s+FISCAL\s*N[º°O]?", r"NF\s*N[º°O]?", r"PEDIDO"),
    "issuer": (r"RAZ[AÃ]O\s+SOCIAL", r"NOME\s+EMPRESARIAL", r"NOME\s*/?\s*RAZ[AÃ]O", r"EMITENTE", r"FORNECEDOR", r"PRESTADOR", r"VENDEDOR"),
    "discount": (r"VALOR\s+DO\s+DESCONTO", r"DESCONTO"),
    "freight": (r"VALOR\s+DO\s+FRETE", r"FRETE"),
    "payment": (r"FORMA\s+DE\s+PAGAMENTO", r"CONDI[CÇ][AÃ]O\s+DE\s+PAGAMENTO", r"MEIO\s+DE\s+PAGAMENTO", r"PAGAMENTO"),
    "notes": (r"OBSERVA[CÇ][OÕ]ES", r"OBSERVA[CÇ][AÃ]O", r"OBS"),
}
ITEM_HEADER = (r"DESCRI[CÇ][AÃ]O", r"PRODUTO", r"DISCRIMINA[CÇ][AÃ]O")
ITEM_END = (*LABELS["total"][:4], r"OBSERV", r"INFORM", r"TRANSPORTE", r"ICMS", r"FRETE")
#: Words that are not order numbers though they follow the label.
NOT_NUMBERS = "N NO NR NUM NUMERO DE DA DO DAS DOS EMITENTE FISCAL NOTA NF NFE INTERNO PEDIDO REF REFERENCIA ORDEM COMPRA COTACAO PROPOSTA º ° Nº N°".split()
#: Words by which a line speaks of the issuer, and of the other party.
ISSUER_MARKS = ("EMITENTE", "PRESTADOR", "FORNECEDOR", "VENDEDOR")
OTHER_PARTY = (r"DESTINAT[AÁ]RIO", "REMETENTE")
#: Amounts, dates, and in item lines the sequence number and the quantity with its unit.
MONEY_BR = r"(?<!\d)(?:R\$\s*)?(?:\d{1,3}(?:\.\d{3})+|\d{1,7}),\d{2}(?!\d)"
MONEY_US = r"(?<!\d)(?:R\$\s*)?(?:\d{1,3}(?:\.\d{3})+|\d{1,7})\.\d{2}(?!\d)"
DATE = r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}\s+DE\s+[A-Z]{3,12}\s+DE\s+\d{4}"
SEQUENCE = r"^\s*\d{1,4}[\s.)\-]"
QUANTITY = r"(\d{1,3}(?:\.\d{3})*(?:,\d+)?|\d+(?:,\d+)?)\s*([A-Z0-9]{1,6})?$"
#: Lines after a label that may hold its value.
REACH = 3

#: What the reading of a text gives; ``ranks`` are the places of the labels that were taken.
FOUND = ("total", "issuer", "issued", "due", "number", "discount", "freight", "payment", "notes")
ITEM = "line int, description string, quantity decimal(38,6), unit string, unit_cents bigint, total_cents bigint"
RESULT = (
    "total bigint, issuer string, issued date, due date, number string, discount bigint, freight bigint, payment string, notes string, issued_ambiguous boolean, "
    f"access_key string, cnpj string, items array<struct<{ITEM}>>, ranks struct<{', '.join(f'{f} int' for f in FOUND)}>"
)

#: As in the patterns of the other functions, ``\s`` and ``\d`` are ASCII, ``$`` lets one line terminator follow, ``.`` meets none.
_SPACE, _ENDS = r" \t\n\x0b\f\r", "\r\x85\u2028\u2029"
_END = rf"(?=[{_ENDS}]?\Z)"
_DOT = rf"[^\n{_ENDS}]"


def _pattern(p: str) -> str:
    out, i, inside = "", 0, False
    while i < len(p):
        two = p[i : i + 2]
        if two in (r"\s", r"\d", r"\D"):
            own = {"s": _SPACE, "d": "0-9", "D": "^0-9"}[two[1]]
            out += own if inside else f"[{own}]"
            i += 2
        elif two[0] == "\\":
            out += two
            i += 2
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out += two[0] if inside else {"$": _END, ".": _DOT}.get(two[0], two[0])
            i += 1
    return out


def _compiled(p: str) -> re.Pattern:
    return re.compile(_pattern(p))


def _any(patterns: tuple[str, ...]) -> re.Pattern:
    """Any of the patterns in this order, each beginning with a letter, by which the search skips what cannot match."""
    return _compiled("|".join(re.sub(r"^\\b(\w)", r"\1(?<=\\b\1)", p) for p in patterns))


def true_label(label: str) -> str:
    """The label only where it begins its line or a colon follows, not as a word of a sentence."""
    return rf"(?:^[\s|-]*(?:{label})|(?:{label})(?=[ \t]*:))"


_LABEL = {k: tuple(map(ocr_pattern, v)) for k, v in LABELS.items()}
_EVERY = _any(tuple(sorted({p for k, v in _LABEL.items() if k != "notes" for p in v}, key=len, reverse=True)))
_HELD = {f: _any(_LABEL[f]) for f in _LABEL}
_SEARCHED = {f: [(_compiled(p), _compiled(rf"(?:{p})[\s:.|-]*$")) for p in (map(true_label, _LABEL[f]) if f == "issuer" else _LABEL[f])] for f in FOUND}
_BR, _US, _DATE, _NUMERIC = _compiled(MONEY_BR), _compiled(MONEY_US), _compiled(DATE), _compiled(r"^(\d{1,4})([/\-.])(\d{1,2})\2(\d{1,4})$")
_SEQUENCE, _QUANTITY, _NUMBER = _compiled(SEQUENCE), _compiled(QUANTITY), re.compile(r"[A-Z0-9][A-Z0-9._/-]{1,29}")
_HEADER, _ITEMS_END, _OWN, _OTHER = (_any(tuple(map(ocr_pattern, p))) for p in (ITEM_HEADER, ITEM_END, ISSUER_MARKS, OTHER_PARTY))
_CNPJ = _compiled(_LABEL["cnpj"][0] + r".*?(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})")
_KEY, _KEY_LINE = _compiled(f"^.*?{_LABEL['key'][0]}"), _compiled(r"^[\d\s.\-]+$")
_LONE, _PAIR = _compiled(r"^\D*\d{0,4}\D[^,]*,\d{2}\s+[A-Z0-9]{1,6}\s*$"), _compiled(r"(?:R\$\s*)?[\d.,]+\s+(?:R\$\s*)?[\d.,]+\s*$")
_EDGES, _CELL_EDGES = _compiled(r"^[ :\t\-|]+|[ :\t\-|]+$"), _compiled(r"^[ |\t]+|[ |\t]+$")
_NO_DIGITS, _MARKS_AFTER, _STOPS_AFTER = re.compile("[^0-9]+"), _compiled(r"[._/-]+$"), _compiled("[.,;]+$")
_NEW_LINE = re.compile("\r?\n")
_LIKE_DIGITS = str.maketrans(*AMBIGUOUS_OCR)
_SKIPPED = {ocr_pattern(w) for w in NOT_NUMBERS}
_COMMA = re.compile(r",(?<=[0-9],)[0-9]{2}(?![0-9])")
_THOUSANDS = re.compile(r"[0-9]+\.[0-9]{3}")
_WIDE, _MILLIONTH, _MOST_CENTS = Context(prec=80), Decimal("0.000001"), 2**63 - 1


def ocr_form(text: str) -> str:
    return text.upper().translate(_LIKE_DIGITS)


def cents(token: str) -> int | None:
    """Of an amount that one of the money patterns found; null beyond what 64 bits hold."""
    n = int(_NO_DIGITS.sub("", token))
    if "," not in token and token.count(".") > 1:  # dots before three digits group, and so does the last one then
        n *= 100
    return n if n <= _MOST_CENTS else None


def quantity(token: str) -> Decimal | None:
    """Of digits with dots and one comma at most: the comma is decimal, dots before three digits group."""
    if "," in token:
        token = token.replace(".", "").replace(",", ".")
    elif token.count(".") > 1 or _THOUSANDS.fullmatch(token):
        token = token.replace(".", "")
    n = _WIDE.create_decimal(token) if len(token) < 70 else Decimal(token)
    if n >= 10**32:
        return None
    n = n.quantize(_MILLIONTH, ROUND_HALF_UP, Context(prec=len(token) + 10))
    return n if n < 10**32 else None


def day(token: str) -> tuple[dt.date, bool] | None:
    """Date of a day-first or year-first number, and whether its day could be a month."""
    m = _NUMERIC.search(token)
    if m is None:
        return None
    a, _, month, c = m.groups()
    first = len(a) != 4
    year, of_month = (c, a) if first else (a, c)
    if len(year) not in (2, 4):
        return None
    y = int(year) if len(year) == 4 else int(year) + (2000 if int(year) < 70 else 1900)
    try:
        value = dt.date(y, int(month), int(of_month))
    except ValueError:
        return None
    return (value, first and value.day <= 12) if 1900 <= y <= 2199 else None


def _letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _has_decimal_comma(form: str) -> bool:
    """Whether MONEY_BR is found: one to seven digits, a comma and two digits. Looking for commas is what is fast."""
    for m in _COMMA.finditer(form):
        before = form[max(m.start() - 8, 0) : m.start()]
        if len(before) < 8 or not (before.isascii() and before.isdigit()):
            return True
    return False


class _Document:
    def __init__(self, text: str):
        self.form = ocr_form(text)
        if "\n" in text:
            self.texts, self.forms = _NEW_LINE.split(text), _NEW_LINE.split(self.form)
        else:
            self.texts, self.forms = [text], [self.form]
        self.money = _BR if _has_decimal_comma(self.form) else _US
        self.joined = "\0".join(self.forms)  # no label goes beyond its line
        self.starts, at = [], 0
        for f in self.forms:
            self.starts.append(at)
            at += len(f) + 1

    def lines_with(self, pattern: re.Pattern) -> list[int]:
        out: list[int] = []
        for m in pattern.finditer(self.joined):
            i = bisect_right(self.starts, m.start()) - 1
            if not out or out[-1] != i:
                out.append(i)
        return out

    def find(self, field: str, value: Callable) -> tuple:
        """The value of the most trusted label, and the label's place among the field's."""
        hits = self.lines_with(_HELD[field])
        if hits:
            for rank, (label, _) in enumerate(_SEARCHED[field]):
                for i in hits:
                    m = label.search(self.forms[i])
                    got = m and value(self.forms[i], self.texts[i], m.end())
                    if got is not None:
                        return got, rank
            for rank, (_, ending) in enumerate(_SEARCHED[field]):
                for i in hits:
                    if ending.search(self.forms[i]):
                        below = next((j for j in range(i + 1, min(i + 1 + REACH, len(self.texts))) if self.texts[j].strip(" ")), None)
                        got = None if below is None else value(self.forms[below], self.texts[below], 0)
                        if got is not None:
                            return got, rank
        return None, None

    def amount(self, form: str, text: str, at: int) -> int | None:
        """The first amount after the label, else the last one of the line. An amount may not begin
        within a number, so the part after the label keeps the character before it."""
        m = self.money.search(form[max(at - 1, 0) :])
        token = m.group() if m else next(reversed(self.money.findall(form)), None)
        return None if token is None else cents(token)

    def date(self, form: str, text: str, at: int) -> tuple[dt.date, bool] | None:
        m = _DATE.search(form[at:])
        token = m.group() if m else next(reversed(_DATE.findall(form)), None)
        return None if token is None else day(token)

    def free_text(self, form: str, text: str, at: int) -> str | None:
        """Up to the next label."""
        m = _EVERY.search(form[at:])
        part = _EDGES.sub("", text[at : at + m.start()] if m else text[at:])
        return part[:200] if len(part) >= 2 and any(map(str.isalnum, part)) else None

    def number(self, form: str, text: str, at: int) -> str | None:
        for token in _NUMBER.findall(text[at:].upper()):
            if any("0" <= c <= "9" for c in token) and token.translate(_LIKE_DIGITS) not in _SKIPPED:
                return _MARKS_AFTER.sub("", token)
        return None

    def access_key(self) -> str | None:
        """The first 44 digits from the label on, over lines that hold nothing else."""
        at = next(iter(self.lines_with(_HELD["key"])), None)
        if at is None:
            return None
        own = _KEY.sub("", self.forms[at], count=1)
        more = [f if _KEY_LINE.search(f) else "|" for f in self.forms[at + 1 : at + 5]]
        found = _NO_DIGITS.sub("", " ".join([own, *more]).partition("|")[0])[:44]
        return found if len(found) == 44 else None

    def issuer_number(self) -> tuple[str | None, int]:
        """The issuer's number after a CNPJ label and its line. Numbers below the first line of the other
        party count only where none stands above or on it; of those that count, the first on a line that
        speaks of the issuer is taken, else the first."""
        found = []
        for i in self.lines_with(_HELD["cnpj"]):
            m = _CNPJ.search(self.forms[i])
            if m:
                found.append((i, _NO_DIGITS.sub("", m.group(1))))
        border = next(iter(self.lines_with(_OTHER)), None) if found else None
        if border is not None:
            found = [x for x in found if x[0] <= border] or found
        at, value = next((x for x in found if _OWN.search(self.forms[x[0]])), next(iter(found), (0, None)))
        return value, at

    def name_above(self, at: int) -> str | None:
        """The nearest of the two lines above line ``at`` that has no label, three characters and a letter."""
        for i in range(at - 1, max(at - 3, -1), -1):
            name = self.texts[i].strip(" ")
            if len(name) >= 3 and _letter(name) and not _EVERY.search(self.forms[i]):
                return name[:200]
        return None

    def items(self) -> list[tuple]:
        """Rows of ITEM between the item header and the first line that ends the table. A line needs two
        amounts, or one, or a sequence number; a quantity needs a unit or two spaces before it; what
        is missing stays null."""
        header = next(iter(self.lines_with(_HEADER)), None)
        if header is None:
            return []
        end = next((i for i in self.lines_with(_ITEMS_END) if i > header), len(self.forms))
        rows = (self.item(i - header, self.forms[i], self.texts[i]) for i in range(header + 1, end) if self.texts[i].strip(" "))
        return [r for r in rows if r is not None]

    def item(self, line: int, form: str, text: str) -> tuple | None:
        tokens = self.money.findall(form)
        n = 0 if len(tokens) == 1 and _LONE.search(form) else len(tokens)  # one number and its unit: no amount
        cut = len(form)
        if n >= 2:
            m = _PAIR.search(form)
            cut = cut - len(m.group()) if m else cut
        elif n == 1:
            cut = form.index(tokens[0])
        f, name = form[:cut].rstrip(" "), text[:cut].rstrip(" ")
        m = _QUANTITY.search(f)
        amount = unit = None
        if m and (m.group(2) or m.start() == 0 or f[max(m.start() - 2, 0) : m.start()] == "  "):
            amount, own = quantity(m.group(1)), len(m.group(2) or "")
            unit = name[max(len(name) - own, 0) :].upper() if own else None
            name = name[: max(len(name) - len(m.group()), 0)].rstrip(" ")
        name = _CELL_EDGES.sub("", _SEQUENCE.sub("", name, count=1))
        if len(name) < 2 or (n == 0 and (len(name) < 3 or not _SEQUENCE.search(form))):
            return None
        return line, name[:200], amount, unit, cents(tokens[-2]) if n >= 2 else None, cents(tokens[-1]) if n else None


def read(text: str | None, message: bool = False) -> tuple:
    """A row of RESULT, items and ranks as tuples. The one unlabelled date of a message counts as the date of issue."""
    doc = _Document(text or "")
    kinds = {"total": doc.amount, "issuer": doc.free_text, "issued": doc.date, "due": doc.date, "number": doc.number, "discount": doc.amount, "freight": doc.amount, "payment": doc.free_text, "notes": doc.free_text}
    found = {f: doc.find(f, kinds[f]) for f in FOUND}
    values, ranks = {f: x[0] for f, x in found.items()}, {f: x[1] for f, x in found.items()}
    issued, ambiguous = values["issued"] or (None, False)
    if issued is None and message:
        every = {(day(x) or (None,))[0] for x in _DATE.findall(doc.form)}
        issued = every.pop() if len(every) == 1 else None
    cnpj, at = doc.issuer_number()
    name = _STOPS_AFTER.sub("", values["issuer"] or "").rstrip(" ")
    if len(name) < 3 or not _letter(name):
        name, ranks["issuer"] = None if cnpj is None else doc.name_above(at), None
    values |= {"issuer": name, "issued": issued, "due": values["due"] and values["due"][0]}
    return (*(values[f] for f in FOUND), ambiguous, doc.access_key(), cnpj, doc.items(), tuple(ranks[f] for f in FOUND))


_ITEM_KINDS = (("line", pa.int32()), ("description", pa.string()), ("quantity", pa.decimal128(38, 6)), ("unit", pa.string()), ("unit_cents", pa.int64()), ("total_cents", pa.int64()))
_KINDS = {"total": pa.int64(), "issued": pa.date32(), "due": pa.date32(), "discount": pa.int64(), "freight": pa.int64(), "issued_ambiguous": pa.bool_()}


def _columns(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> list[pa.Array]:
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return [pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)]


def read_all(texts: pa.Array, messages: pa.Array) -> pa.Array:
    """A struct of RESULT for each text."""
    rows = [read(t, bool(m)) for t, m in zip(texts.to_pylist(), messages.to_pylist(), strict=True)]
    names = [*FOUND, "issued_ambiguous", "access_key", "cnpj"]
    plain = _columns([r[:-2] for r in rows], [(n, _KINDS.get(n, pa.string())) for n in names])
    ends = [0]
    for r in rows:
        ends.append(ends[-1] + len(r[-2]))
    flat = pa.StructArray.from_arrays(_columns([i for r in rows for i in r[-2]], list(_ITEM_KINDS)), [n for n, _ in _ITEM_KINDS])
    ranks = pa.StructArray.from_arrays(_columns([r[-1] for r in rows], [(f, pa.int32()) for f in FOUND]), list(FOUND))
    return pa.StructArray.from_arrays([*plain, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), ranks], [*names, "items", "ranks"])
