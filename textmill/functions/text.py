"""Column-level text functions (all JVM built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Special tokens, in id order; their ids follow the mergeable tokens.
SPECIAL_TOKENS = [
    "<|bos|>",
    "<|user_start|>",
    "<|user_end|>",
    "<|assistant_start|>",
    "<|assistant_end|>",
    "<|python_start|>",
    "<|python_end|>",
    "<|output_start|>",
    "<|output_end|>",
]
# Pre-token split pattern (GPT-4 style, digits grouped by one or two).
SPLIT_PATTERN = (
    r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,2}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""
)
# Prompt text of a rendered multiple-choice question.
MC_HEADER = "Multiple Choice question: "
MC_FOOTER = "\nRespond only with the letter of the correct answer."
# Default per-document character cap used when sampling text for BPE training.
DOC_CAP = 10000
# ---------------------------------------------------------------------------

# The byte tokenizer: ids 0..255 are UTF-8 bytes, specials follow in order.
N_BYTES = 256
SPECIAL_ID = {name: N_BYTES + i for i, name in enumerate(SPECIAL_TOKENS)}
BOS = SPECIAL_ID["<|bos|>"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pretokenize(text) -> Column:
    """Pre-token chunks; ``(?U)`` gives Java the Unicode ``\\s`` and case rules."""
    return F.regexp_extract_all(_c(text), F.lit("(?U)" + SPLIT_PATTERN), 0)


def byte_tokens(text, prepend=None) -> Column:
    """UTF-8 bytes of ``text`` as ``array<int>`` (optionally a leading special id).

    The UTF-8 bytes are re-read as ISO-8859-1, which maps byte ``b`` to the
    character ``U+00b``; splitting into characters and taking code points is
    linear in the text (substring indexing would be quadratic).
    """
    t = _c(text)
    latin = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    arr = F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.split(latin, ""), lambda ch: F.ascii(ch)))
    if prepend is not None:
        arr = F.concat(F.array(F.lit(int(prepend))), arr)
    return arr


def bytes_to_text(ids) -> Column:
    """Inverse of :func:`byte_tokens` for ids 0..255 (others are skipped)."""
    chars = F.transform(F.filter(_c(ids), lambda i: (i >= 0) & (i < 256)), lambda i: F.chr(i))
    return F.decode(F.encode(F.array_join(chars, ""), "ISO-8859-1"), "UTF-8")


def byte_token_count(text, prepend: bool = False) -> Column:
    return F.octet_length(_c(text)) + F.lit(1 if prepend else 0)


def doc_cap(text, n: int = DOC_CAP) -> Column:
    """First ``n`` characters (code points, like Python slicing)."""
    return F.substring(_c(text), 1, n)


def lang_letter_ratio(text, letters: str) -> Column:
    """(# chars in ``letters``) / (# alphabetic chars); 0 when there are none."""
    t = _c(text)
    marked = F.length(F.regexp_replace(t, "[^" + letters + "]", ""))
    alpha = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when(alpha == 0, F.lit(0.0)).otherwise(marked / alpha)


def render_mc(question, letters, choices) -> Column:
    """Multiple-choice prompt: header, one ``- choice=letter`` line each, footer."""
    lines = F.zip_with(_c(choices), _c(letters),
                       lambda ch, le: F.concat(F.lit("- "), ch, F.lit("="), le, F.lit("\n")))
    return F.concat(F.lit(MC_HEADER), _c(question), F.lit("\n"), F.array_join(lines, ""),
                    F.lit(MC_FOOTER))


def slugify(c) -> Column:
    return F.replace(F.lower(_c(c)), F.lit(" "), F.lit("-"))
