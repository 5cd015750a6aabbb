"""Scalar text functions, Column in and Column out. Lengths are UTF-8 bytes unless a name says characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def trim(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def words(x: Column) -> Column:
    """Runs of non-white characters."""
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def word_count(x: Column) -> Column:
    return F.size(words(x))


def safe_truncate(x: Column, n: Column | int) -> Column:
    """The longest prefix of at most n bytes that ends between characters."""
    n = F.lit(n) if isinstance(n, int) else n
    raw = x.cast("binary")
    cut = lambda k: F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(n - k, F.lit(0))).cast("string"))
    return F.when(F.octet_length(x) <= n, x).otherwise(F.coalesce(*(cut(k) for k in range(4))))


def preview(x: Column, n: int = 100, mark: str = "...") -> Column:
    return F.when(F.octet_length(x) > n, F.concat(safe_truncate(x, n), F.lit(mark))).otherwise(x)


def squeeze(x: Column, n: int, mark: str = "…") -> Column:
    """White space as single blanks, cut to n characters."""
    flat = trim(F.regexp_replace(x, r"\s+", " "))
    return F.when(F.char_length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit(mark))).otherwise(flat)


def squeeze_bytes(x: Column, n: int, mark: str = "…") -> Column:
    """White space as single blanks, cut to n bytes between characters."""
    return preview(trim(F.regexp_replace(x, r"\s+", " ")), n, mark)


def extractive_summary(x: Column) -> Column:
    """The first two sentences of more than 15 bytes among the first 2000; else the first 150 bytes."""
    parts = F.transform(F.split(safe_truncate(x, fixed.GATHER_BYTES), "[.!?]"), trim)
    good = F.slice(F.filter(parts, lambda s: F.octet_length(s) > 15), 1, 2)
    return F.when(F.size(good) > 0, F.array_join(F.transform(good, lambda s: F.concat(s, F.lit("."))), " ")).otherwise(safe_truncate(x, 150))


def token_estimate(content: Column, role: Column) -> Column:
    return F.floor((F.octet_length(content) + F.octet_length(role) + 10) / 4).cast("long")


def comma_list(x: Column) -> Column:
    """Items between commas without quotes and full stops around them; single bytes go."""
    bare = F.transform(F.split(x, ","), lambda s: F.regexp_replace(trim(s), r"^[\"'.]+|[\"'.]+$", ""))
    return F.filter(bare, lambda s: F.octet_length(s) > 1)


def keyed_row(names: list[str], values: list[Column]) -> Column:
    """`Name: value | Name: value` of the non-empty values; if all are empty, the values joined."""
    pairs = [F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{n}: "), v)) for n, v in zip(names, values, strict=True)]
    kept = F.array_compact(F.array(*pairs))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | ")).otherwise(F.concat_ws(" | ", *(F.coalesce(v, F.lit("")) for v in values)))


def file_name(path: Column) -> Column:
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when(name == "", "Untitled").otherwise(name)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def cost(input_tokens: Column, output_tokens: Column, rate_in: Column, rate_out: Column) -> Column:
    return input_tokens / 1e6 * rate_in + output_tokens / 1e6 * rate_out


def cost_text(x: Column) -> Column:
    return F.when(x < 0.01, F.format_string("$%.4f", x)).otherwise(F.format_string("$%.2f", x))


def latency_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.format_string("%dms", ms)).otherwise(F.format_string("%.1fs", ms / 1000))


def confidence_band(x: Column) -> Column:
    return F.when(x >= 0.7, "high").when(x >= 0.4, "med").otherwise("low")


def conversation_title(message: Column) -> Column:
    return F.substring(message, 1, 40)


def node_label(content: Column, summary: Column, node_type: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), F.nullif(summary, F.lit("")), F.concat(F.lit("("), node_type, F.lit(")")))


def documents_label(n: Column, name: Column) -> Column:
    return F.when(n == 1, name).otherwise(F.concat(n.cast("string"), F.lit(" documents")))


def page_count(x: Column) -> Column:
    """Form feeds, one at least."""
    return F.greatest(F.char_length(x) - F.char_length(F.replace(x, F.lit("\f"), F.lit(""))), F.lit(1))


def retry_after_ms(error: Column) -> Column:
    """Milliseconds that a message asks to wait, 30 s at most: the first number behind the word and one more character; null if there is none."""
    seconds = F.regexp_extract(F.lower(error), r"(?s)retry-after.[^0-9]*([0-9]+)", 1).try_cast("long")
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(30)) * 1000)


def backoff_ms(attempt: Column) -> Column:
    return (300 * F.pow(F.lit(2.0), attempt)).cast("long")


def is_retryable(error: Column) -> Column:
    """Status codes and phrases that a later call may cure, and network errors."""
    return error.rlike(r"429|500|502|503|529|rate limit|overloaded|(?i:connection|timed? ?out)")


def chatml(system: Column, user: Column) -> Column:
    return F.format_string("<|im_start|>system\n%s<|im_end|>\n<|im_start|>user\n%s<|im_end|>\n<|im_start|>assistant\n", system, user)


def step_label(tool: Column) -> Column:
    out = tool
    for k, v in fixed.STEP_LABELS.items():
        out = F.when(tool == k, v).otherwise(out)
    return out


def plain_number(x: Column) -> Column:
    """A double without exponent or trailing zeros: 1.0 as 1, 1e7 as 10000000."""
    fixed_text = F.format_string("%.10f", x)
    return F.regexp_replace(F.regexp_replace(fixed_text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def data_address(mime_type: Column, data: Column) -> Column:
    """Bytes as a data address in base64, on one line, which base64() breaks after 76 characters by default; null for null."""
    return F.concat(F.lit("data:"), mime_type, F.lit(";base64,"), F.replace(F.base64(data), F.lit("\r\n"), F.lit("")))
