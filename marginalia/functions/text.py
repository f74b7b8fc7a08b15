"""Scalar expressions over note text, dates, identifiers and messages."""

from __future__ import annotations

import sys
import warnings

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from marginalia.schema import SD

# workers then need no copy of this module on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Header marker, date forms, token limits.
HEADER = "FECHA DE EDICIÓN DE LA NOTA:"
DATE_FORMS = ("yyyy-M-d", "yyyy_M_d", "d/M/yyyy", "d-M-yyyy", "yyyy/M/d")
# Further forms that need no Python.
LATER_DATE_FORMS = (
    "yyyyMMdd", "d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "MMM d yyyy", "MMMM d yyyy",
    "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d H:m",
)
MAX_SEQ_LENGTH = 20480
MAX_OUTPUT_TOKENS = 8192
PROMPT_MARGIN = 16
MIN_OUTPUT_TOKENS = 256

_OUTER_SPACE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(value: Column) -> Column:
    """Without white space of any kind at both ends. A pattern bound to the end alone would be tried at every place of the text."""
    return F.btrim(value, F.lit(_OUTER_SPACE))


def normalize_cell(value: Column) -> Column:
    """A cell as trimmed text, empty where null."""
    return F.coalesce(strip(value.cast("string")), F.lit(""))


def input_text(date: Column, body: Column) -> Column:
    return F.concat(F.lit(HEADER + " "), date, F.lit("\n\n"), body)


def read_dates(cells: pd.Series) -> pd.Series:
    """Dates in any other writing as ``dd/MM/yyyy``, month before day where both could be; null where none is read."""
    warnings.simplefilter("ignore")  # about forms that are read one by one
    known = {cell: pd.to_datetime(cell, errors="coerce", dayfirst=False) for cell in cells.dropna().unique()}
    return cells.map(lambda cell: None if cell is None or pd.isna(known[cell]) else known[cell].strftime("%d/%m/%Y"))


def norm_date(value: Column) -> Column:
    """Any date form as ``dd/MM/yyyy``, otherwise unknown. Only cells in none of the listed forms are read in Python."""
    cell = normalize_cell(value)
    head = F.substring(cell, 1, 10)
    tried = [F.try_to_date(head, form) for form in DATE_FORMS]
    tried += [F.try_to_timestamp(cell, F.lit(form)).cast("date") for form in LATER_DATE_FORMS]
    listed = F.date_format(F.coalesce(*tried), "dd/MM/yyyy")
    other = F.pandas_udf(read_dates, "string")(F.when(listed.isNull() & (cell != ""), cell))
    return F.coalesce(listed, other, F.lit(SD))


def date_to_iso(value: Column) -> Column:
    """``dd/MM/yyyy`` as ``yyyy-MM-dd``; unknown stays unknown."""
    day = F.try_to_date(value, "dd/MM/yyyy")
    return F.when(value == SD, value).otherwise(F.date_format(day, "yyyy-MM-dd"))


def norm_match(value: Column) -> Column:
    """Text with single spaces under a collation that ignores case and accents."""
    return F.collate(F.trim(F.regexp_replace(value, r"\s+", " ")), "UNICODE_CI_AI")


def event_bucket(total: Column) -> Column:
    return F.when(total >= 3, F.lit("3+")).otherwise(total.cast("string"))


def stratum_key(has_events: Column, total: Column) -> Column:
    return F.concat(
        F.lit("has_events="), has_events.cast("string"), F.lit("|events="), event_bucket(total)
    )


def token_proxy(text: Column) -> Column:
    """A quarter of the characters, rounded half to even, at least one."""
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("long"))


def header_count(text: Column, marker: str = HEADER) -> Column:
    return F.regexp_count(text, F.lit("\\Q" + marker + "\\E"))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def token_budget(prompt_tokens: Column, limit: int = MAX_SEQ_LENGTH, cap: int = MAX_OUTPUT_TOKENS) -> Column:
    """Output budget left by a prompt."""
    room = F.greatest(F.lit(0), F.lit(limit) - prompt_tokens - PROMPT_MARGIN)
    return F.least(F.lit(cap), room)


def budget_block(prompt_tokens: Column, limit: int = MAX_SEQ_LENGTH, cap: int = MAX_OUTPUT_TOKENS) -> Column:
    """Why a prompt cannot run, or null."""
    budget = token_budget(prompt_tokens, limit, cap)
    return (
        F.when(
            prompt_tokens >= limit,
            F.concat(F.lit("prompt_tokens="), prompt_tokens.cast("string"), F.lit(f" >= max_seq_length={limit}")),
        )
        .when(
            budget < MIN_OUTPUT_TOKENS,
            F.concat(F.lit("computed max_tokens="), budget.cast("string"), F.lit(f" < {MIN_OUTPUT_TOKENS}")),
        )
    )


def note_id_fallback(assistant_json: Column, user_text: Column, line_no: Column) -> Column:
    """Id from the gold record, else the header date of the user turn, else the line number."""
    gold_id = F.nullif(F.get_json_object(assistant_json, "$.nota.nota_id"), F.lit(""))
    first_line = F.split(user_text, r"\r\n|\r|\n").getItem(0)
    header = F.when(
        first_line.startswith(HEADER), F.nullif(strip(F.substr(first_line, F.lit(len(HEADER) + 1))), F.lit(""))
    )
    return F.coalesce(gold_id, header, F.concat(F.lit("line_"), line_no.cast("string")))


def event_id(note_id: Column, number: Column) -> Column:
    return F.concat(note_id, F.lit("__evento_"), F.format_string("%03d", number))


def json_quoted(text: Column) -> Column:
    """A text as JSON string with its quotes, null for null.

    Through a list of one text: rendering a VARIANT sets up a JSON writer for every single text.
    """
    shown = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(shown, F.lit(2), F.length(shown) - 2))
