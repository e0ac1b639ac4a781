"""Names, search keys, hashes and tokens of texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title words, spelling classes and the alphabet.
TITLES = ["lensgrevinde", "lensgreve", "grevinde", "greve", "komtesse", "comtesse", "baronesse", "baron", "friherreinde", "friherre", "von", "af", "til", "de"]
SPELLINGS = [
    ["frederik", "friedrich", "fritz"],
    ["henrik", "hinrich", "heinrich", "henrich"],
    ["detlev", "detlef", "ditlev"],
    ["margrethe", "margarethe", "margaretha"],
    ["dorothea", "dorthe"],
    ["cai", "kaj", "kay"],
    ["christian", "kristian"],
    ["gotskalk", "gottschalk", "godskalk"],
    ["cathrina", "catharina", "katharina", "cathrine", "catharine", "katharine"],
]
ALPHABET = "AÁBCDEÉFGHIÍJKLMNOÓPQRSTUÚVWXYZÆØÅ"
ACCENTS = {"A": "ÀÂÄÃ", "E": "ÈÊË", "I": "ÌÎÏ", "O": "ÒÔÖÕ", "U": "ÙÛÜ", "C": "Ç", "N": "Ñ"}
#: Ordered spelling rules: pattern and replacement.
FOLDS = [
    ("th", "t"), ("ph", "f"), ("c(?=[aoulr])", "k"), ("w", "v"), ("ck", "k"),
    (r"([bcdfghjklmnpqrstvxz])\1+", "$1"), ("aa", "å"), ("ö", "ø"), ("ü", "y"), ("^(.{3,})a$", "$1e"),
]


def _folded(word: Column) -> Column:
    for pattern, by in FOLDS:
        word = F.regexp_replace(word, pattern, by)
    return word


def _fold_plain(word: str) -> str:
    import re

    for pattern, by in FOLDS:
        word = re.sub(pattern, by.replace("$", "\\"), word)
    return word


def spelling_classes() -> dict[str, str]:
    """Folded spelling -> the folded first spelling of its class."""
    return {_fold_plain(w): _fold_plain(c[0]) for c in SPELLINGS for w in c}


def fold_name_word(word: Column) -> Column:
    """The spelling that stands for a word of a name when names are compared."""
    w = _folded(F.lower(F.trim(F.coalesce(word, F.lit("")))))
    classes = F.create_map(*[F.lit(x) for kv in spelling_classes().items() for x in kv])
    return F.coalesce(F.element_at(classes, w), w)


def match_key(name: Column) -> Column:
    """A name without titles and particles, each word folded; '' for null. Never shown, only compared."""
    low = F.lower(F.coalesce(name, F.lit("")))
    bare = F.regexp_replace(low, r"(?<![a-z0-9_])(?:" + "|".join(TITLES) + r")(?![a-z0-9_])", " ")
    words = F.filter(F.transform(F.split(F.trim(bare), r"\s+"), fold_name_word), lambda w: w != "")
    return F.array_join(words, " ")


def surname_words(name: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), "[‐‑–]", "-"), r"\s+", " ")), r"\s+")


def ends_with_words(name: Column, surname: Column) -> Column:
    """Are the last words of name those of surname? False if either is null."""
    n, s = surname_words(name), surname_words(surname)
    tail = F.slice(n, F.greatest(F.size(n) - F.size(s) + 1, F.lit(1)), F.size(s))
    return F.coalesce((F.size(n) >= F.size(s)) & (tail == s), F.lit(False))


def danish_key(text: Column) -> Column:
    """A string whose binary order is the alphabet's: two digits of rank and four of the character, letter by letter; unknown characters last."""
    chars = F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: c != "")
    upper = F.translate(F.upper(F.coalesce(text, F.lit(""))), "".join(ACCENTS.values()), "".join(k * len(v) for k, v in ACCENTS.items()))
    ranks = F.filter(F.split(upper, ""), lambda c: c != "")
    rank = lambda c: F.when(F.instr(F.lit(ALPHABET), c) > 0, F.instr(F.lit(ALPHABET), c)).otherwise(F.lit(99))
    return F.array_join(F.transform(chars, lambda c, i: F.concat(F.lpad(rank(F.get(ranks, i)).cast("string"), 2, "0"), F.lpad(F.hex(F.ascii(c)), 5, "0"))), "")


def initial(name: Column) -> Column:
    """The first letter of the last word, upper case; '#' without one."""
    last = F.element_at(F.split(F.trim(F.coalesce(name, F.lit(""))), r"\s+"), -1)
    letter = F.upper(F.regexp_extract(last, r"\p{L}", 0))
    return F.when(letter == "", F.lit("#")).otherwise(letter)


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units of the text, as a long: a character beyond the first plane is two."""
    units = F.regexp_extract_all(F.hex(F.encode(F.coalesce(text, F.lit("")), "UTF-16BE")), F.lit("[0-9A-F]{4}"), 0)
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, u: (h.bitwiseXOR(F.conv(u, 16, 10).cast("long")) * F.lit(16777619)) % F.lit(1 << 32))


def _mul32(a: Column, b: Column) -> Column:
    """a * b modulo 2 ** 32 for unsigned 32-bit numbers in longs: the high half of a is multiplied by itself, so that nothing overflows."""
    low, high = a.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(a, 16)
    return (low * b + ((high * b) % F.lit(1 << 16)) * F.lit(1 << 16)) % F.lit(1 << 32)


def draw(seed: Column, k: Column) -> Column:
    """The k-th number (from 1) in [0, 1) of a seeded generator, in closed form: rows are independent of one another."""
    a = (seed.cast("long") + _mul32(k.cast("long") % F.lit(1 << 32), F.lit(0x6D2B79F5).cast("long"))) % F.lit(1 << 32)
    shift = lambda x, n: F.shiftrightunsigned(x, n)
    t = _mul32(a.bitwiseXOR(shift(a, 15)), a.bitwiseOR(F.lit(1).cast("long")))
    t = t.bitwiseXOR((t + _mul32(t.bitwiseXOR(shift(t, 7)), t.bitwiseOR(F.lit(61).cast("long")))) % F.lit(1 << 32))
    return t.bitwiseXOR(shift(t, 14)).cast("double") / F.lit(float(1 << 32))


def fingerprint(*parts: Column, context: Column) -> Column:
    """md5 over the parts and the context, kept apart by the unit separator; null reads as empty."""
    return F.md5(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts], F.coalesce(context, F.lit(""))))


def mentions(text: Column) -> Column:
    """An array of (type, id) for every ``[[type:id`` in the text, closed or not, once each."""
    form = r"\[\[([a-zæøå_]+):(\d+)"
    kinds, ids = F.regexp_extract_all(text, F.lit(form), 1), F.regexp_extract_all(text, F.lit(form), 2)
    return F.array_distinct(F.transform(kinds, lambda k, i: F.struct(k.alias("type"), F.get(ids, i).cast("long").alias("id"))))


def first_quotable(text: Column, low: int = 40, high: int = 180) -> Column:
    """The first sentence of low to high characters, or null."""
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.get(F.filter(parts, lambda s: F.char_length(s).between(low, high)), F.lit(0))


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance by the haversine formula."""
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), F.lit(2.0))
    h = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.lit(2 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


# Letters and the ASCII that stands for them in older dumps.
ASCII_FORMS = {"æ": "ae", "ø": "oe", "å": "aa", "ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}


def place_key(name: Column) -> Column:
    """Lower case, single blanks, no punctuation at the end."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\s+", " ")
    return F.trim(F.regexp_replace(bare, "[.,;:]+$", ""))


def place_leaf(name: Column) -> Column:
    """The first part of a place from small to large."""
    return F.trim(F.substring_index(name, ",", 1))


def ascii_form(text: Column) -> Column:
    for letter, ascii_ in ASCII_FORMS.items():
        text = F.replace(text, F.lit(letter), F.lit(ascii_))
    return text


def coordinate(raw: Column, limit: float) -> Column:
    """A coordinate as written, or null: no number, zero, or beyond the limit."""
    v = raw.try_cast("double")
    return F.when((v != 0) & (F.abs(v) <= limit), v)
