"""Character classes shared by all functions, as regular-expression class bodies valid in Java and in RE2.

White space is Unicode White_Space everywhere: Java's and RE2's ``\\s`` are ASCII only.
"""

# Unicode White_Space; scripts; dependent signs and consonants.
WS = "\\x{9}-\\x{d} \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
SI, TA, LATIN = "\\x{d80}-\\x{dff}", "\\x{b80}-\\x{bff}", "A-Za-z"
SI_SIGNS, SI_CONSONANTS = "\\x{dca}-\\x{ddf}\\x{df2}\\x{df3}", "\\x{d9a}-\\x{dc6}"
TA_SIGNS, TA_CONSONANTS = "\\x{bbe}-\\x{bcd}\\x{bd7}", "\\x{b95}-\\x{bb9}"
JOINERS = "\\x{200c}\\x{200d}"
INDIC = SI + TA
#: What may stand in a word with Sinhala or Tamil letters, besides ASCII letters.
ALLOWED = INDIC + JOINERS + "0-9!-/:-@\\[-`{-~\\x{2018}-\\x{201f}\\x{2013}\\x{2014}\\x{2026}\\x{a0}"

WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
ZWJ, ZWNJ, SI_VIRAMA, TA_VIRAMA = "‍", "‌", "්", "்"


def is_si(c: str) -> bool:
    return "඀" <= c <= "෿"


def is_indic(c: str) -> bool:
    return "඀" <= c <= "෿" or "஀" <= c <= "௿"


def is_si_consonant(c: str) -> bool:
    return "ක" <= c <= "ෆ"


def is_consonant(c: str) -> bool:
    return "ක" <= c <= "ෆ" or "க" <= c <= "ஹ"
