"""Text columns: canonical form, shingles, hashes, similarity, names."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Footer words, and the letters that tell the three languages apart.
FOOTER = r"підпис|подпис|subscribe"
UK_ONLY, RU_ONLY = "іїєґ", "ыэёъ"
# Signs of monitoring channels and the words that they stand for; longer signs before their parts.
SIGNS = {
    "🛵": "шахед", "🚀": "ракета", "✈️": "авіація", "✈": "авіація", "🛩️": "авіація", "🛩": "авіація", "🚁": "гелікоптер", "💥": "вибух", "🔴": "тривога", "🟢": "відбій", "🟡": "", "🚨": "тривога",
    "⚠️": "", "⚠": "", "❗": "", "❗️": "", "‼️": "", "🎯": "", "📍": "", "➡️": "курсом на", "➡": "курсом на", "→": "курсом на", "⬆️": "у північному напрямку", "⬇️": "у південному напрямку", "⬅️": "у західному напрямку",
    "↗️": "у північно-східному напрямку", "↘️": "у південно-східному напрямку", "↙️": "у південно-західному напрямку", "↖️": "у північно-західному напрямку",
}


#: About so many bytes of a batch of texts are worked on at once, and no more rows than this.
SLICE_BYTES, SLICE_ROWS = 1_000_000, 500


def in_slices(values: pa.Array, work: Callable[[list], pa.Array]) -> pa.Array:
    """``work`` over a batch, slice by slice, so that what Python holds does not follow the batch; free memory is given back."""
    done, start = [], 0
    rows = max(1, min(SLICE_ROWS, SLICE_BYTES * max(1, len(values)) // max(1, values.nbytes)))
    while start < len(values) or not done:
        done.append(work(values.slice(start, rows).to_pylist()))
        start += rows
    out = pa.concat_arrays(done) if len(done) > 1 else done[0]
    del done
    pa.default_memory_pool().release_unused()
    return out


def nfc(text: Column) -> Column:
    """Canonical composition; plain ASCII passes untouched."""

    @F.arrow_udf("string")
    def composed(values: pa.Array) -> pa.Array:
        return in_slices(values, lambda texts: pa.array([v if v is None or v.isascii() else unicodedata.normalize("NFC", v) for v in texts], pa.string()))

    return composed(text)


def canonical(text: Column) -> Column:
    """Lower-case letters and digits of each line without links, mentions and tags; short footer lines go. Null: empty."""
    bare = F.regexp_replace(F.lower(nfc(F.coalesce(text, F.lit("")))), r"(https?://|www\.|t\.me/)\S+|[@#][\p{L}\p{N}_]+", " ")
    lines = F.transform(F.split(bare, "\n"), lambda v: F.trim(F.regexp_replace(v, r"[^\p{L}\p{Nd}]+", " ")))
    kept = F.filter(lines, lambda v: (v != "") & ~((F.length(v) <= 40) & F.regexp_like(v, F.lit(FOOTER))))
    return F.array_join(kept, " ")


def shingles(text: Column, size: int = 4) -> Column:
    """Distinct character runs of a length; a shorter text is one, an empty one none."""
    def of(chars: Column) -> Column:  # bound once: an expression inside a lambda would be split anew for each run
        last = F.greatest(F.size(chars) - size + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(chars, i, size), ""))

    runs = F.array_distinct(F.element_at(F.transform(F.array(F.split(text, "")), of), 1))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(runs)


def hashed_runs(text: str | None, size: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct character runs of a length; a shorter text is one run, an empty one has none."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = max(len(codes) - size + 1, min(len(codes), 1))
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(codes))):
            h = (h + codes[k : k + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def shingle_hashes(text: Column, size: int = 4) -> Column:
    """:func:`hashed_runs` of each text, made in batches."""

    @F.arrow_udf("array<long>")
    def hashed(values: pa.Array) -> pa.Array:
        return in_slices(values, lambda texts: pa.array([hashed_runs(v, size) for v in texts], pa.list_(pa.int64())))

    return hashed(text)


def fnv1a(values: Column) -> Column:
    """64-bit FNV-1a over UTF-16 code units, low byte first, of each string of an array."""

    @F.arrow_udf("array<long>")
    def hashed(arrays: pa.Array) -> pa.Array:
        out = []
        for words in arrays.to_pylist():
            row = []
            for w in words or []:
                h = 0xCBF29CE484222325
                for b in w.encode("utf-16-le"):
                    h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
                row.append(h - (1 << 64) if h >> 63 else h)
            out.append(row if words is not None else None)
        return pa.array(out, pa.list_(pa.int64()))

    return hashed(values)


def minhash(values: Column, size: int = 64, seed: int = 17) -> Column:
    """``size`` least values of a family of functions of each array's 64-bit hashes; empty arrays have no signature."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, size, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, size, dtype=np.uint64)

    def least_of(row: list | None) -> list:
        if not row:
            return []
        x, least = np.array(row, np.int64).view(np.uint64), np.full(size, np.iinfo(np.uint64).max)
        for at in range(0, len(x), 8192):  # a long text is no wider than a short one
            with np.errstate(over="ignore"):
                h = x[at : at + 8192, None] * a + b
                h ^= h >> np.uint64(33)
                h *= np.uint64(0xFF51AFD7ED558CCD)
            least = np.minimum(least, h.min(0))
        return (least >> np.uint64(32)).astype(np.int64).tolist()

    @F.arrow_udf("array<long>")
    def signature(arrays: pa.Array) -> pa.Array:
        return in_slices(arrays, lambda rows: pa.array([least_of(row) for row in rows], pa.list_(pa.int64())))

    return signature(values)


def bands(signature: Column, n: int = 16, rows: int = 4) -> Column:
    """Keys of ``n`` bands of a signature, the band's number inside the key."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, rows)))
    return F.when(F.size(signature) > 0, keys).otherwise(F.array().cast("array<long>"))


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v))
    return F.when(F.size(a) > 0, equal / F.size(a)).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def clean(text: Column) -> Column:
    """Message text for matching: links and marks gone, signs as words, quotes, dashes and apostrophes folded, lower case, ё as е."""
    t = F.regexp_replace(nfc(F.coalesce(text, F.lit(""))), r"\[([^\]]*)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"(https?://|www\.|t\.me/)\S+", " ")
    for sign, word in SIGNS.items():
        t = F.replace(t, F.lit(sign), F.lit(f" {word} "))
    t = F.translate(F.lower(t), "ё«»“”„’ʼ`—–−", "е\"\"\"\"\"'''---")
    return F.regexp_replace(t, r"[^\p{L}\p{N}\n.,!?;:'\"/+%°()-]+", " ")


def segments(text: Column, questions: bool = False) -> Column:
    """Sentences of each line; a point between digits, or behind one letter or a short known word, ends none.

    With ``questions``, a sentence keeps its question mark.
    """
    ends = r"[.!;]+|(?<=\?)(?!\?)" if questions else r"[.!?;]+"
    held = F.regexp_replace(text, r"(?<=\p{N})\.(?=\p{N})|(?<=\b(?:м|с|р|н|ст|обл|вул|св|ім|st|no|mr|dr)\b)\.", "\u0001")
    parts = F.flatten(F.transform(F.split(held, "\n"), lambda v: F.split(v, ends)))
    trimmed = F.transform(parts, lambda v: F.trim(F.regexp_replace(F.translate(v, "\u0001", "."), r"^[\s•▪*·-]+", "")))
    return F.filter(trimmed, lambda v: v != "")


def tokens(text: Column) -> Column:
    """Words with their inner hyphens, apostrophes, slashes and points."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+(?:[-'/.][\p{L}\p{N}]+)*"), F.lit(0))


def token_spans(text: Column) -> Column:
    """Array of struct(token, start, end): the tokens of a text and where they stand, in characters from 0, end excluded."""
    none = F.array().cast("array<struct<token:string,start:int,end:int>>")
    state = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def place(s: Column, token: Column) -> Column:
        start = F.position(token, text, s["at"] + 1) - 1  # between two tokens stands nothing that could begin one
        end = start + F.length(token)
        return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(token.alias("token"), start.alias("start"), end.alias("end")))).alias("spans"))

    return F.aggregate(tokens(text), state, place, lambda s: s["spans"])


def language(text: Column) -> Column:
    """uk, ru or en by the letters only one of them has; Ukrainian where nothing decides."""
    t = F.lower(F.coalesce(text, F.lit("")))
    count = lambda letters: F.length(t) - F.length(F.translate(t, letters, ""))
    latin = F.length(F.regexp_replace(t, "[^a-z]", ""))
    cyrillic = F.length(F.regexp_replace(t, "[^а-яіїєґё]", ""))
    return F.when(latin > cyrillic, "en").when(count(RU_ONLY) > count(UK_ONLY), "ru").otherwise("uk")


def stem_match(stem: Column, token: Column, exact: Column) -> Column:
    """A token that starts with the stem and adds at most four letters, or a hyphen and letters.

    In exact mode it must equal the stem; behind a digit two letters of an ending are allowed.
    """
    rest = F.substring(token, F.length(stem) + 1, F.length(token))
    loose = F.regexp_like(rest, F.lit(r"^(\p{L}{0,4}|-\p{L}+)$"))
    strict = (rest == "") | (F.regexp_like(stem, F.lit(r"\p{N}")) & F.regexp_like(rest, F.lit(r"^-?\p{L}{1,2}$")))
    return token.startswith(stem) & F.when(exact, strict).otherwise(loose)


def folded_name(name: Column) -> Column:
    """Place names for comparing: one apostrophe, one dash, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), "’ʼ`‘—–−", "''''---"), r"\s+", " "))


def admin_key(name: Column) -> Column:
    """Names of communities without their different words for community."""
    return F.trim(F.regexp_replace(folded_name(name), r"(^|\s)(територіальна громада|громада|отг|тг)(?=\s|$)", " "))


def name_variants(name: Column) -> Column:
    """Stems under which a settlement's inflected name is found: the last vowel cut, adjectives cut, vowels alternating."""
    n = folded_name(name)
    short = F.regexp_replace(n, r"(ський|ська|ське|ий|а|я|о|е|и|і|ь|й)$", "")
    closed = F.regexp_replace(short, r"і(?=[^аеєиіїоуюя\s]$)", "о")
    soft = F.regexp_replace(short, r"ї(?=[^аеєиіїоуюя\s]$)", "є")
    return F.array_distinct(F.filter(F.array(n, short, closed, soft), lambda v: F.length(v) >= 3))


def channel_name(text: Column) -> Column:
    """A channel's bare name from @name, a link or a path."""
    return F.lower(F.regexp_extract(F.trim(text), r"^(?:https?://)?(?:t\.me/|telegram\.me/)?(?:s/)?@?([A-Za-z0-9_]+)", 1))


def shared_words(a: Column, b: Column, least: int = 4) -> Column:
    """struct(words, share): words of some length in both texts, and their share of the shorter text's words."""
    words = lambda t: F.array_distinct(F.filter(tokens(F.lower(t)), lambda w: F.length(w) >= least))
    both = F.array_sort(F.array_intersect(words(a), words(b)))
    n = F.least(F.size(words(a)), F.size(words(b)))
    return F.struct(both.alias("words"), F.when(n > 0, F.size(both) / n).otherwise(F.lit(0.0)).alias("share"))


def preview(text: Column, n: int = 300) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)
