"""Text expressions: hashes, names, tokens, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def content_hash(name: Column, description: Column, content: Column) -> Column:
    """MD5 of the three fields joined by bars; null counts as empty."""
    return F.md5(F.concat_ws("|", _blank(name), _blank(description), _blank(content)).cast("binary"))


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a over the text's characters, as a number (code units; equal to code points below U+10000)."""
    codes = F.transform(F.filter(F.split(_blank(text), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(4294967295)))


def fnv1a32_on(state: Column, codes: list) -> Column:
    """The hash :func:`fnv1a32` goes on to from ``state`` over codes of characters; a null one is none.

    One arithmetic expression without arrays, for rows that are many more than what they are made of.
    """
    for code in codes:
        fixed = isinstance(code, int)
        by = F.lit(16777619) if fixed else F.when(code.isNull(), 1).otherwise(16777619)
        state = (state.bitwiseXOR(F.lit(code).cast("long") if fixed else F.coalesce(code, F.lit(0)).cast("long")) * by).bitwiseAND(F.lit(4294967295))
    return state


def node_id(kind: Column, name: Column) -> Column:
    return F.concat(F.lit("gn-"), F.lower(F.hex(fnv1a32(F.concat_ws("|", kind, name)))))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return edge_id_of(fnv1a32(F.concat_ws("|", source, target, kind)))


def edge_id_of(hashed: Column) -> Column:
    return F.concat(F.lit("ge-"), F.lower(F.hex(hashed)))


def normal_name(name: Column) -> Column:
    """Lower case, letters a-z, digits and common CJK only."""
    return F.regexp_replace(F.lower(_blank(name)), "[^a-z0-9\\u4e00-\\u9fa5]", "")


def slug(text: Column) -> Column:
    """First 24 characters if CJK, else at most 40 with everything but a-z and 0-9 as single hyphens."""
    plain = F.regexp_replace(F.substring(F.lower(text), 1, 40), "[^a-z0-9]+", "-")
    return F.when(text.rlike("[\\u4e00-\\u9fa5]"), F.substring(text, 1, 24)).otherwise(F.regexp_replace(plain, "^-+|-+$", ""))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(_blank(text)), r"[^\p{L}\p{N}]+"), lambda t: t != "")


#: Han, Kana and Hangul.
_CJK = "\\u3040-\\u30ff\\u3400-\\u4dbf\\u4e00-\\u9fff\\uac00-\\ud7af"


def search_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; a run of CJK characters is its pairs of neighbours (itself, if it is one)."""
    apart = F.regexp_replace(F.lower(_blank(text)), f"([{_CJK}]+)", " $1 ")
    runs = F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    pairs = F.transform(runs, lambda t: F.when(t.rlike(f"^[{_CJK}]{{2,}}$"), F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(t) - 1)), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array(t)))
    return F.flatten(pairs)


def f1_tokens(text: Column) -> Column:
    """Distinct tokens for the F1 score: what is no word character, CJK or space becomes a space."""
    cleaned = F.regexp_replace(F.lower(_blank(text)), r"[^\w一-鿿\s]", " ")
    return F.array_distinct(F.filter(F.split(cleaned, r"\s+"), lambda t: t != ""))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two token sets; 0 if either is empty or nothing is shared."""
    x, y = f1_tokens(a), f1_tokens(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when(shared > 0, 2.0 * shared / (F.size(x) + F.size(y))).otherwise(0.0)


def chunks(text: Column, size: int = 400, overlap: int = 40) -> Column:
    """Pieces of ``size`` characters that overlap; the last ends with the text.  Empty for no text."""
    step = size - min(overlap, size - 1)
    n = F.char_length(_blank(text))
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step)))).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(cut)


def embed_text(name: Column, description: Column, content: Column, limit: int = 800) -> Column:
    return F.substring(F.concat(_blank(name), F.lit(": "), _blank(description), F.lit("\n"), _blank(content)), 1, limit)


def xml_escape(text: Column) -> Column:
    out = _blank(text)
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out
