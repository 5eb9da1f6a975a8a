"""Tests of free text: instructions to the reader, secrets, traces of machines, document kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import Any, _c, clean_spaces, ocr_form, ocr_pattern, strip_accents

#: Instructions to an automatic reader, in lower case without marks.
INJECTION_TEXT = (
    r"ignore\s+(as\s+|todas\s+as\s+)?(instrucoes|orientacoes|regras|comandos)",
    r"ignore\s+(previous|all\s+previous|the\s+above)\s+instructions",
    r"disregard\s+(the\s+)?(previous\s+)?instructions",
    r"desconsidere\s+(as\s+|todas\s+as\s+)?(instrucoes|regras)",
    r"instrucoes\s+(anteriores|acima)",
    r"voce\s+(agora\s+)?e\s+(um|uma|o|a)\s",
    r"you\s+are\s+now",
    r"(grave|gravar|registre|registrar|lance|lancar|anote|anotar|salve|escreva|considere)\s+(como\s+)?(o\s+|esse\s+|este\s+)?(valor|total|preco)",
    r"(sobrescreva|substitua|altere|atualize|mude|modifique)\s+(o\s+|os\s+|esse\s+)?(valor|total|preco|dados|registro)",
    r"valor\s+(de\s+|final\s+de\s+)?(99999|999\.?999|9\.?999\.?999)",
    r"novo\s+total",
    r"total\s+(correto|real)\s+e",
    r"system\s*prompt",
    r"prompt\s+do\s+sistema",
    r"como\s+(um\s+)?assistente",
    r"ignore\s+o\s+(valor|documento)",
    r"nao\s+confira",
)
#: The same by line of a document, in upper case.
INJECTION_LINES = (
    r"IGNORE\s+(AS\s+)?INSTRU[CÇ][OÕ]ES",
    r"IGNORE\s+PREVIOUS",
    r"IGNORAR\s+(AS\s+)?INSTRU[CÇ][OÕ]ES",
    r"DESCONSIDERE\s+(AS\s+)?(INSTRU[CÇ][OÕ]ES|O\s+PROMPT)",
    r"GRAVE\s+COMO",
    r"GRAVAR?\s+COMO",
    r"REGISTRE\s+COMO",
    r"REGISTRAR?\s+COMO",
    r"ANOTE\s+COMO",
    r"LAN[CÇ]E\s+COMO",
    r"CONSIDERE\s+COMO",
    r"VALOR\s+99999",
    r"(VALOR|TOTAL)\s+DE?\s*99999",
    r"(SYSTEM|ASSISTANT|USER)\s*:",
    r"YOU\s+ARE\s+NOW",
    r"VOC[EÊ]\s+AGORA\s+[EÉ]",
    r"NOVAS?\s+INSTRU[CÇ][OÕ]ES",
    r"OVERRIDE",
    r"SUPERE\s+AS\s+INSTRU",
    r"N[AÃ]O\s+IMPORTA\s+O\s+VALOR",
    r"ESQUE[CÇ]A\s+(AS\s+)?(INSTRU[CÇ][OÕ]ES|REGRAS)",
)
#: Shapes of credentials.
SECRETS = (
    ("chave-privada", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("token-telegram", r"\b\d{8,13}:[A-Za-z0-9_-]{30,}\b"),
    ("token-meta", r"\bEAA[A-Za-z0-9_-]{20,}\b"),
    ("token-google", r"\bAIza[A-Za-z0-9_-]{30,}\b"),
    ("token-openai", r"\bsk-[A-Za-z0-9]{32,}\b"),
    ("token-github", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b"),
    ("telefone", r"\b55\d{10,11}\b"),
)
#: Words that mark a value as an example.
PLACEHOLDER = r"(?i)(fake|fictic|dummy|placeholder|exemplo|teste|test-|nao-e-segredo|troque|seu-|minha-|xxx|aaaa|1111|1234567890|nao[-_ ]?pode[-_ ]?aparecer|nao[-_ ]?vaza|apenas|somente|so[-_ ]?para|mascar|prova|redacted|redigid)"
ASSIGNMENT = r"(?i)^\s*(?:export\s+)?([A-Z0-9_]*(?:TOKEN|SECRET|PASSWORD|API_KEY|SENHA)[A-Z0-9_]*)\s*=\s*(\S.*)$"
#: Traces of a machine in a text.
TRACES = (
    ("caminho da maquina", r"(?i)[A-Z]:[\\/]{1,2}Users[\\/]"),
    ("caminho de sistema unix", r"(?<![\w.])/(home|Users)/[A-Za-z0-9._-]+/"),
    ("nome de pasta pessoal", r"Meu Computador"),
)
SECRET_FILES = r"(?i)(^|/)(secrets|credentials|id_rsa)[^/]*$|\.(pem|key)$"


def injection_in_text(x: Any) -> Column:
    """Does the text tell an automatic reader what to do? Null and blank do not."""
    return F.coalesce(F.lower(strip_accents(clean_spaces(x))).rlike("|".join(INJECTION_TEXT)), F.lit(False))


def lines_of(x: Any) -> Column:
    return F.split(F.coalesce(_c(x), F.lit("")), r"\r?\n")


def injection_lines(x: Any) -> Column:
    """Array of struct(line, text): lines that hold an instruction, numbered from 1."""
    pattern = "|".join(f"(?:{ocr_pattern(p)})" for p in INJECTION_LINES)
    found = F.transform(lines_of(x), lambda t, i: F.when(ocr_form(t).rlike(pattern), F.struct((i + 1).alias("line"), F.trim(t).alias("text"))))
    return F.array_compact(found)


def secret_findings(x: Any) -> Column:
    """Array of struct(line, kind, verdict): ``placeholder`` where the line or the value says so or
    a character repeats six times, else ``suspeito``."""

    def of_line(t: Column, i: Column) -> Column:
        found = [(kind, F.regexp_extract(t, f"({p})", 1)) for kind, p in SECRETS] + [("atribuicao", F.regexp_extract(t, ASSIGNMENT, 2))]
        verdict = lambda v: F.when(t.rlike(PLACEHOLDER) | v.rlike(r"(.)\1{5,}"), "placeholder").otherwise("suspeito")
        return F.array_compact(F.array(*[F.when(v != "", F.struct((i + 1).alias("line"), F.lit(kind).alias("kind"), verdict(v).alias("verdict"))) for kind, v in found]))

    return F.flatten(F.transform(lines_of(x), of_line))


def trace_findings(x: Any) -> Column:
    """Array of struct(line, kind) of traces of machines."""
    return F.flatten(F.transform(lines_of(x), lambda t, i: F.array_compact(F.array(*[F.when(t.rlike(p), F.struct((i + 1).alias("line"), F.lit(kind).alias("kind"))) for kind, p in TRACES]))))


#: Words of an invoice that alone decide, words of which two do, and words of an order.
INVOICE_STRONG = (r"DANFE", r"NOTA\s+FISCAL", r"CHAVE\s+DE\s+ACESSO", r"VALOR\s+TOTAL\s+DA\s+NOTA", r"NF-?E\b")
INVOICE_WEAK = (r"CNPJ", r"INSCRI[CÇ][AÃ]O\s+ESTADUAL", r"DESTINAT[AÁ]RIO", r"ICMS", r"BASE\s+DE\s+C[AÁ]LCULO", r"NATUREZA\s+DA\s+OPERA[CÇ][AÃ]O")
ORDER_MARKS = (r"PEDIDO", r"ORDEM\s+DE\s+COMPRA", r"OR[CÇ]AMENTO", r"COTA[CÇ][AÃ]O", r"PROPOSTA")


def classify(x: Any) -> Column:
    text = ocr_form(x)
    weak = sum((text.rlike(ocr_pattern(p)).cast("int") for p in INVOICE_WEAK), F.lit(0))
    some = lambda patterns: text.rlike("|".join(map(ocr_pattern, patterns)))
    return F.when(some(INVOICE_STRONG) | (weak >= 2), "nf").when(some(ORDER_MARKS), "pedido").otherwise("desconhecido")
