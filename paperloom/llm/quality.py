"""Line-first quality rules: judge every line, remove the failures, then reject documents that lost too much text.

A line without a word is neither judged nor counted. A line with words fails, by the first rule that holds:

* punctuation: matches of SYMBOLS exceed ``max_symbol_share`` of its words;
* navigation: two or more separators, at most three words to a separator;
* boilerplate: phrases of BOILERPLATE, as whole words, make up half of its words or more;
* fragment: it has under ``min_line_words`` words and does not end in a mark of END.

A document is rejected by the base rules (under 50 words; over half of its words in repeated 3-word windows), or when
the lines that failed hold over ``max_lost`` of its words. Null texts count as empty, which fails. Repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import hash_words, per_text, windows

# Fixed values of the rules.
SYMBOLS = r"[#*$%&|<>]|!!"
SEPARATORS = r"[|>»•·]"
END = r"[.!?…;:\"'”’»)\]]\s*$"
BOILERPLATE = {
    "de": ["alle rechte vorbehalten", "datenschutzerklärung", "datenschutz", "impressum", "nutzungsbedingungen", "hier klicken", "weiterlesen", "mehr lesen", "anmelden", "abmelden", "registrieren", "newsletter abonnieren", "nach oben", "zum inhalt springen", "diese seite verwendet cookies"],
    "en": ["all rights reserved", "privacy policy", "cookie policy", "terms of use", "terms of service", "terms and conditions", "this site uses cookies", "we use cookies", "accept cookies", "accept all cookies", "click here", "read more", "learn more", "contact us", "sign in", "sign up", "log in", "log out", "subscribe", "subscribe now", "share this", "share on", "back to top", "skip to content", "skip to main content"],
    "es": ["todos los derechos reservados", "política de privacidad", "aviso legal", "política de cookies", "términos de uso", "haga clic aquí", "leer más", "iniciar sesión", "registrarse", "suscríbete", "compartir en", "volver arriba", "saltar al contenido"],
    "fr": ["tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "cliquez ici", "lire la suite", "se connecter", "s'inscrire", "s'abonner", "partager sur", "haut de page", "aller au contenu"],
    "it": ["tutti i diritti riservati", "informativa sulla privacy", "termini di utilizzo", "clicca qui", "leggi tutto", "accedi", "iscriviti", "torna su"],
    "pt": ["todos os direitos reservados", "política de privacidade", "termos de uso", "clique aqui", "leia mais", "iniciar sessão", "inscreva-se", "voltar ao topo"],
}

_SYMBOL, _SEP, _END = map(re.compile, (SYMBOLS, SEPARATORS, END))
_PHRASES = sorted({p for phrases in BOILERPLATE.values() for p in phrases}, key=lambda p: (-len(p), p))
_SIGNS = b"#*$%&|<>"
_BLANK = b" \t\n\x0b\x0c\r"
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def boilerplate_words(line: str) -> int:
    """Words of a line that phrases of BOILERPLATE hold, longer phrases first."""
    line = " ".join(line.lower().split())
    if not (found := [p for p in _PHRASES if p in line]):
        return 0
    return sum(len(m.split()) for m in re.findall(rf"(?<!\w)(?:{'|'.join(map(re.escape, found))})(?!\w)", line))


def failure(line: str, n_words: int, max_symbol_share: float = 0.3, min_line_words: int = 4) -> str | None:
    """Name of the first rule that a line with words fails."""
    if len(_SYMBOL.findall(line)) > max_symbol_share * n_words:
        return "punctuation"
    if (seps := len(_SEP.findall(line))) >= 2 and n_words - seps <= 3 * seps:
        return "navigation"
    if 2 * boilerplate_words(line) >= n_words:
        return "boilerplate"
    if n_words < min_line_words and not _END.search(line):
        return "fragment"
    return None


def measure(raw: bytes) -> list[int]:
    """The LONGS of a text."""
    words = raw.split()
    chars = len(raw) - sum(map(raw.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    if not raw.isascii():
        b = np.frombuffer(raw, np.uint8)
        chars -= int(((b & 0xC0) == 0x80).sum())
    symbols = sum(raw.count(c) for c in b"#*$%&|<>")
    lines = [x for x in raw.split(b"\n") if x.strip(_BLANK)]
    repeated = 0
    if len(words) >= 3:
        w = windows(hash_words(words), 3)
        order = np.argsort(w, kind="stable")
        same = w[order][1:] == w[order][:-1]
        if same.any():
            twice = np.zeros(len(w) + 2, bool)
            at = np.concatenate((order[1:][same], order[:-1][same]))
            for i in range(3):
                twice[at + i] = True
            repeated = int(twice.sum())
    return [len(words), chars, symbols, len(lines) - len(set(lines)), repeated]


def clean_lines(text: str, **limits) -> tuple[str, int, list[tuple[int, str]]]:
    """Text without the failed lines, words lost, (line number, rule) of each failed line."""
    kept, lost, failed = [], 0, []
    for i, line in enumerate(text.split("\n")):
        n = len(line.encode().split())
        if n and (rule := failure(line, n, **limits)):
            lost += n
            failed.append((i, rule))
        else:
            kept.append(line)
    return "\n".join(kept), lost, failed


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost: float = 0.5, min_words: int = 50, max_repeat: int = 50, with_text: bool = False, **limits) -> DataFrame:
    """id, the LONGS, base_failed, kept, lost_words, failed_lines and, on request, clean_text."""
    fields = [T.StructField(x, T.LongType()) for x in LONGS] + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("lost_words", T.LongType()), T.StructField("failed_lines", T.LongType())]
    fields += [T.StructField("clean_text", T.StringType())] * with_text

    def make():

        def f(texts):
            rows = []
            for raw in texts:
                m = measure(raw)
                text, lost, failed = clean_lines(raw.decode("utf-8", "replace"), **limits)
                base = m[0] < min_words or 100 * m[4] > max_repeat * m[0]
                rows.append([*m, base, not base and lost <= max_lost * m[0], lost, len(failed), *[text] * with_text])
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in fields]

        return f

    return per_text(df, id_col, text_col, T.StructType(fields), make)
