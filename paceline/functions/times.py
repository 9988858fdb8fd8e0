"""Time arithmetic, parsing and formatting.

Durations are doubles in milliseconds, wall-clock times doubles in epoch
seconds.  ANSI mode is on by default, so parsing goes through ``try_cast`` and
ratios through ``try_divide``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted time text, and the epoch cut-off of the boards.
MMSS_PATTERN = r"^\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*\.\s*([+-]?\d+)\s*$"
NUMBER_PATTERN = r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"
INT_PREFIX = r"^\s*([+-]?\d+)"
FLOAT_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
EPOCH_CUTOFF_MS = 1e12


def _num(text: Column) -> Column:
    return text.try_cast("double")


def _two(n: Column) -> Column:
    """At least two digits, as ``%02d``; string functions are far cheaper than a formatter."""
    text = n.cast("bigint").cast("string")
    return F.when((n >= 0) & (n < 10), F.concat(F.lit("0"), text)).otherwise(text)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _scaled_units(x: Column, scale: int) -> Column:
    """``abs(x) * scale`` rounded to a whole number as if multiplied exactly."""
    size = F.abs(x)
    split = size * F.lit(134217729.0)  # 2**27 + 1: upper half of the significand
    high = split - (split - size)
    product = size * scale
    error = (high * scale - product) + (size - high) * scale
    tie = (product - F.floor(product)) == 0.5
    # From 2**53 on every double is whole, and a cast could overflow.
    exact = product < float(1 << 53)
    rounded = F.when(tie & (error != 0), F.floor(product) + (error > 0).cast("int")).otherwise(
        F.rint(product)
    )
    return F.when(exact, rounded.cast("bigint"))


def fixed(x: Column, digits: int) -> Column:
    """Text with 1 to 6 decimals, rounded from the exact binary value.

    ``format_string`` rounds the shortest decimal text half up, so 0.1328125
    would print as 0.132813 instead of 0.132812.  Here a tie of the scaled value
    is settled by the exact error of the product, then half to even.
    """
    scale = 10**digits

    def text(v: Column) -> Column:
        sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
        number = _let(
            _scaled_units(v, scale),
            lambda n: F.concat(
                F.floor(n / scale).cast("string"),
                F.lit("."),
                F.lpad((n % scale).cast("string"), digits, "0"),
            ),
        )
        large = F.format_string(f"%.{digits}f", v)
        odd = F.when(F.isnan(v), F.lit("nan")).when(F.abs(v) == float("inf"), F.concat(sign, F.lit("inf")))
        return F.when(v.isNotNull(), F.coalesce(F.concat(sign, number), odd, large))

    return _let(x, text)


def _whole(x: Column) -> Column:
    """Drop the fraction, toward zero."""
    return x.cast("bigint")


def _clock_text(minutes: Column, seconds: Column, centis: Column) -> Column:
    return F.concat(_two(minutes), F.lit(":"), _two(seconds), F.lit("."), _two(centis))


def parse_mmss(text: Column, strict_fraction: bool = False) -> Column:
    """``MM:SS.cc`` to ms, -1 when the text has another shape, NULL stays NULL.

    The fraction counts centiseconds whatever its width ("1:2.5" is 62 050 ms);
    ``strict_fraction`` reads it as a decimal fraction instead.
    """
    part = lambda i: _num(F.regexp_extract(text, MMSS_PATTERN, i))
    fraction = part(3) * 10
    if strict_fraction:
        digits = F.length(F.regexp_extract(text, MMSS_PATTERN, 3))
        fraction = part(3) * F.pow(F.lit(10.0), 3 - digits)
    total = part(1) * 60000 + part(2) * 1000 + fraction
    return F.when(text.isNotNull(), F.coalesce(total, F.lit(-1.0)))


def parse_edit_time(text: Column) -> Column:
    """Clock or finish edit: plain numbers are ms, other text is ``MM:SS.cc``.

    Text of neither shape and negative ``MM:SS.cc`` give NULL (rejected).
    """
    parsed = parse_mmss(text)
    number = F.when(text.rlike(NUMBER_PATTERN), _num(text))
    return F.coalesce(number, F.when(parsed >= 0, parsed))


def parse_cell(text: Column) -> Column:
    """Table-cell time ``MM:SS.ss`` with a real fraction.

    Returns ``struct<ok, ms>``: blank is ok with NULL; anything but two
    ``:``-parts is not ok; unreadable numbers are ok with NULL.
    """
    blank = strip(text) == ""
    parts = F.split(text, ":", -1)
    minutes = _num(F.regexp_extract(F.get(parts, F.lit(0)), INT_PREFIX, 1))
    seconds = _num(F.regexp_extract(F.get(parts, F.lit(1)), FLOAT_PREFIX, 1))
    ok = blank | (F.size(parts) == 2)
    ms = F.when(~blank & (F.size(parts) == 2), (minutes * 60 + seconds) * 1000)
    return F.struct(ok.alias("ok"), ms.alias("ms"))


def strip(text: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fmt_mmss(ms: Column) -> Column:
    """``MM:SS.cc`` with floored parts; minutes are unbounded, NULL gives ''."""
    seconds = F.floor(ms / 1000)
    text = _clock_text(
        F.floor(seconds / 60),
        F.pmod(seconds, F.lit(60)),
        _whole(F.pmod(ms, F.lit(1000.0)) / 10),
    )
    return F.when(ms.isNull() | F.isnan(ms), F.lit("")).otherwise(text)


def fmt_mmss_ui(ms: Column) -> Column:
    """Board variant: signed remainders below zero, missing gives 00:00.00."""
    seconds = F.floor(ms / 1000)
    text = _clock_text(
        F.floor(seconds / 60), seconds % 60, F.floor((ms % F.lit(1000.0)) / 10)
    )
    return F.when(ms.isNull() | F.isnan(ms), F.lit("00:00.00")).otherwise(text)


def fmt_signed(ms: Column) -> Column:
    """Race clock text: magnitude with a leading minus when below zero."""
    seconds = F.abs(ms) / 1000
    text = _clock_text(
        F.floor(seconds / 60),
        F.floor(seconds % F.lit(60.0)),
        F.floor((seconds % F.lit(1.0)) * 100),
    )
    return F.concat(F.when(ms < 0, F.lit("-")).otherwise(F.lit("")), text)


def fmt_video(ms: Column) -> Column:
    """Video time of the track board; centiseconds come from the seconds."""
    seconds = ms / 1000
    whole = _whole(seconds)
    return _clock_text(
        F.floor(seconds / 60),
        _whole(F.pmod(seconds, F.lit(60.0))),
        _whole((seconds - whole) * 100),
    )


def fmt_elapsed(seconds: Column) -> Column:
    """``MM:SS`` of elapsed seconds."""
    return F.concat(
        _two(F.floor(seconds / 60)), F.lit(":"), _two(_whole(F.pmod(seconds, F.lit(60.0))))
    )


def duration_s(frames: Column, fps: Column) -> Column:
    return F.when(fps > 0, frames / fps).otherwise(F.lit(0.0))


def fmt_duration(frames: Column, fps: Column) -> Column:
    return fmt_elapsed(duration_s(frames, fps))


def lag_speed(elapsed_s: Column, video_s: Column) -> Column:
    """``struct<lag_s, speed, text>``; no figures until time has passed."""
    started = elapsed_s > 0
    lag = F.when(started, elapsed_s - video_s)
    speed = F.when(started, F.try_divide(video_s, elapsed_s))
    figures = F.concat(
        F.lit("Lag: "), fixed(lag, 1), F.lit("s (Speed: "), fixed(speed, 1), F.lit("x)")
    )
    text = F.when(started, figures).otherwise(F.lit("Lag: Calculating..."))
    return F.struct(lag.alias("lag_s"), speed.alias("speed"), text.alias("text"))


def official_ms(wall_s: Column, start_s: Column, offset_ms: Column, status: Column) -> Column:
    """Finish time against a running clock, NULL while it is not running."""
    running = start_s.isNotNull() & (status == "running")
    return F.when(running, (wall_s - start_s) * 1000 + offset_ms)


def normalize_epoch(
    ms: Column, start_s: Column, offset_ms: Column, null_as: float | None = None
) -> Column:
    """Turn an epoch-sized value into elapsed ms, never below zero.

    The offset is subtracted here although ``official_ms`` adds it.
    """
    elapsed = F.floor(ms - start_s * 1000 - F.coalesce(offset_ms, F.lit(0.0)) + 0.5)
    known = (ms > EPOCH_CUTOFF_MS) & start_s.isNotNull() & (start_s != 0)
    out = F.when(known, F.greatest(F.lit(0.0), elapsed.cast("double"))).otherwise(ms)
    return out if null_as is None else F.coalesce(out, F.lit(float(null_as)))


def race_time(now_s: Column, start_s: Column, offset_ms: Column, status: Column) -> Column:
    """What the clock shows now."""
    running = (status == "running") & start_s.isNotNull() & (start_s != 0)
    return F.when(running, (now_s - start_s) * 1000 + offset_ms).otherwise(offset_ms)


def quick_add_ms(now_s: Column, start_s: Column, offset_ms: Column, status: Column) -> Column:
    """Finish time of a manual entry, whole ms."""
    offset = F.coalesce(offset_ms, F.lit(0.0))
    running = (status == "running") & start_s.isNotNull() & (start_s != 0)
    rounded = F.floor((now_s - start_s) * 1000 + offset + 0.5).cast("double")
    return F.when(running, rounded).otherwise(offset)


def fmt_clock(ts: Column) -> Column:
    return F.date_format(ts, "hh:mm:ss a")


def fmt_pct(ratio: Column) -> Column:
    return F.when(ratio.isNull(), F.lit("")).otherwise(fixed(ratio, 6))
