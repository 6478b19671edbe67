"""Text folding, tokenising, n-gram and display helpers as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _compatible(ranges: list[range]) -> dict[str, str]:
    """Characters whose compatibility form without marks is plain ASCII, with that form, derived from Unicode."""
    found = {}
    for code in (c for r in ranges for c in r):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if plain and plain.isascii() and plain.isprintable() and plain.strip() == plain:
            found[chr(code)] = plain
    return found


# Latin letters with marks, ordinal signs, superscripts, ligatures and full-width forms.
_FORMS = _compatible([range(0x00AA, 0x0250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F)])
ACCENTED = "".join(c for c, plain in _FORMS.items() if len(plain) == 1)
PLAIN = "".join(plain for plain in _FORMS.values() if len(plain) == 1)
LIGATURES = {c: plain for c, plain in _FORMS.items() if len(plain) > 1}


def strip_marks(text: Column) -> Column:
    """Remove accents from precomposed Latin letters, write ordinal signs, superscripts, ligatures and
    full-width letters plainly and drop combining marks."""
    joined = "".join(LIGATURES)
    spread = text
    for char, plain in LIGATURES.items():
        spread = F.replace(spread, F.lit(char), F.lit(plain))
    # The few multi-letter forms are looked for only in texts that hold one.
    spread = F.when(F.rlike(text, F.lit(f"[{joined}]")), spread).otherwise(text)
    return F.regexp_replace(F.translate(spread, ACCENTED, PLAIN), r"\p{M}+", "")


def squeeze(text: Column) -> Column:
    """Collapse runs of white space to one blank and trim."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}]+", " "))


def fold(text: Column) -> Column:
    """Case- and accent-insensitive comparison form (lower case)."""
    return F.lower(strip_marks(text))


def fold_upper(text: Column) -> Column:
    """Search form of a name: upper case, no accents, single blanks."""
    return squeeze(F.upper(strip_marks(text)))


#: Texts of these characters only fold the same way inside Catalyst.
SIMPLE = r"^[\t\n\r -~ªºÀ-ÅÇ-ÖÙ-Ýà-åç-öù-ýÿ]*$"


def fold_exact(text: Column | str) -> Column:
    """Full compatibility decomposition, for scripts beyond precomposed Latin. Only texts that need it go to Python, so that
    its batches hold no others."""
    text = F.col(text) if isinstance(text, str) else text
    simple = F.rlike(text, F.lit(SIMPLE))
    return F.when(simple, fold_upper(text)).otherwise(_fold_exact(F.when(~simple, text)))


@F.pandas_udf(T.StringType())
def _fold_exact(text: pd.Series) -> pd.Series:
    def one(value):
        if value is None:
            return None
        spread = unicodedata.normalize("NFKD", value).upper()
        return " ".join("".join(c for c in spread if not unicodedata.combining(c)).split())

    return text.map(one, na_action="ignore")


def tokens(text: Column) -> Column:
    """Letter/digit runs in order, repeats kept."""
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def alphanumerics(text: Column) -> Column:
    """Number of letters and digits."""
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def occurrences(text: Column, token: Column) -> Column:
    """Non-overlapping occurrences of ``token`` inside ``text``."""
    return (F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)


def token_needs(wanted: Column) -> Column:
    """Distinct tokens with how often each is asked for."""
    return F.transform(F.array_distinct(wanted), lambda t: F.struct(
        t.alias("t"), F.size(F.filter(wanted, lambda other: other == t)).alias("n")))


def meets_needs(text: Column, needs: Column) -> Column:
    """Every needed token occurs often enough; counting is left to tokens asked for repeatedly."""
    def met(held: Column) -> Column:
        every = F.forall(needs, lambda s: F.contains(held, s["t"]) & ((s["n"] == 1) | (occurrences(held, s["t"]) >= s["n"])))
        return F.when(held.isNotNull(), every).otherwise(F.lit(False))

    # The text is named outside the lambdas, where it is computed once, and so that a filter over a join is not
    # offered to the side that holds only the array, where it cannot run.
    return F.element_at(F.transform(F.array(text), met), 1)


def contains_tokens(text: Column, wanted: Column) -> Column:
    """Every token occurs in ``text`` at least as often as in ``wanted``, in any order."""
    return meets_needs(text, token_needs(wanted))


def contains_words(text: Column, wanted: Column) -> Column:
    """Every word of the array occurs somewhere in ``text``."""
    return F.when(text.isNotNull(), F.forall(wanted, lambda w: F.contains(text, w))).otherwise(F.lit(False))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams; a zero-width look-ahead keeps this linear in the text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(...))"), F.lit(1)))


def probe_grams(longest_first: Column, limit: int = 12) -> Column:
    """First, middle and last trigram of each token (at least 3 long), at most ``limit``."""
    per_token = F.transform(
        F.filter(longest_first, lambda t: F.length(t) >= 3),
        lambda t: F.array(
            F.substring(t, 1, 3),
            F.substring(t, F.floor((F.length(t) - 3) / 2).cast("int") + 1, F.lit(3)),
            F.substring(t, F.length(t) - 2, F.lit(3)),
        ),
    )
    return F.slice(F.array_distinct(F.flatten(per_token)), 1, limit)


def by_length(words: Column) -> Column:
    """Tokens sorted longest first, ties alphabetically."""
    keyed = F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs of any length compare by value: each is written without leading
    zeros behind its length."""
    def run(piece):
        digits = F.ltrim(piece, F.lit("0"))
        return F.when(F.rlike(piece, F.lit(r"^[0-9]")), F.concat(F.lpad(F.length(digits).cast("string"), 8, "0"), digits)).otherwise(piece)

    return F.array_join(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), run), "")


def spanish_key(text: Column) -> Column:
    """Sort key of Spanish text: blind to case and accents, ñ after all other words with n, digits by value."""
    kept = F.regexp_replace(F.lower(text), "ñ|n\u0303", "n\uffff")
    return natural_key(fold(kept))


# Display spellings of common subject words.
SPELLINGS = (
    "Árabe Asesoría Biología Clínicos Composición Construcción Diagnósticos Dirección Edificación "
    "Educación Eléctricas Electrónicos Electrotecnia Electrotécnicos Energéticos Escénicas "
    "Fabricación Filosofía Física Francés Geografía Geología Informática Informáticas Inglés "
    "Instalación Latín Máquinas Matemáticas Mecánica Música Operación Organización Ortoprotésicos "
    "Plásticas Producción Química Químicos Automáticos Técnicas Técnicos Tecnología Vehículos"
).split()
# Joining words kept in lower case, and acronyms with their display form.
JOINING = ["Del", "De", "Las", "Los", "La", "El", "Y"]
ACRONYMS = {"Ies": "IES", "Eoi": "EOI", "Cifppu": "CIFP", "Cpeibas": "CPEIBas"}
CAPITALS = "Ceip Cee Cifp Eso Fp Ii Iii Iv Vi Vii Viii Ix Xi Xii Xiii Xiv Xv Xvi".split()


def _word(pattern: str) -> str:
    return rf"(?<![A-Za-z0-9_])(?:{pattern})(?![A-Za-z0-9_])"


def display_title(text: Column) -> Column:
    """Title case for display with known spellings, joining words and acronyms."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    pieces = F.transform(
        F.split(lowered, r"(?<=[\s/(])"),
        lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, 2, 1 << 30)),
    )
    cased = F.array_join(pieces, "")
    spelling = F.create_map(*[F.lit(x) for w in SPELLINGS for x in (_plain(w), w)])
    runs = F.split(cased, r"(?<=\p{L})(?=\P{L})|(?<=\P{L})(?=\p{L})")
    spelled = F.array_join(F.transform(runs, lambda r: F.coalesce(F.try_element_at(spelling, fold(r)), r)), "")
    marked = F.regexp_replace(spelled, r"(\s)(%s)(?=\s)(\s)" % "|".join(JOINING), "$1\u0001$2$3")
    for word in JOINING:
        marked = F.replace(marked, F.lit("\u0001" + word), F.lit(word.lower()))
    for word, shown in ACRONYMS.items():
        marked = F.regexp_replace(marked, _word(word), shown)
    for word in CAPITALS:
        marked = F.regexp_replace(marked, _word(word), word.upper())
    return marked


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).lower()


def split_destination(text: Column) -> Column:
    """``center · municipality`` into two display fields; a repeated suffix is dropped."""
    parts = F.split(text, " · ")
    center, place = parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    suffix = F.concat(F.lit(" ("), place, F.lit(")"))
    bare = F.when((place != "") & F.endswith(center, suffix),
                  F.substring(center, F.lit(1), F.length(center) - F.length(suffix))).otherwise(center)
    return F.struct(display_title(bare).alias("center"), display_title(place).alias("municipality"))
