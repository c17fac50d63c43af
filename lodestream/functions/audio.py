"""Lengths, windows and headers of audio as Catalyst expressions on whole numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import stable_bucket

# Fixed values of the front ends.
RATE = 16_000
HOP = 160
CHUNK_SECONDS = 30
CHUNK_FRAMES = 1500
FRAMES_A_SECOND = 50
LONGEST_SECONDS = 720
MOST_SAMPLES = 1 << 62
MOST_IN_HEADER = (1 << 36) - 1
POLICIES = ("skip", "chunk_pad", "center_crop", "random_crop")


def div(a: Column, b: Column | int) -> Column:
    """Whole quotient of what isn't negative."""
    return F.call_function("div", a.cast("long"), b.cast("long") if isinstance(b, Column) else F.lit(b).cast("long"))


def ceil_div(a: Column, b: int) -> Column:
    return div(a.cast("long") + (b - 1), b)


def mel_frames(samples: Column) -> Column:
    return ceil_div(samples, HOP)


def convolved(length: Column, kernel: int, stride: int, padding: int) -> Column:
    """Length after a convolution."""
    return div(length + (2 * padding - kernel), stride) + 1


def encoder_frames(mel: Column) -> Column:
    """Frames of the encoder's two convolutions (kernel 3, padding 1, strides 1 and 2)."""
    return convolved(convolved(mel, 3, 1, 1), 3, 2, 1)


def chunked_encoder_frames(samples: Column, chunk_seconds: int = CHUNK_SECONDS) -> Column:
    """Frames of audio that is cut into chunks: whole chunks in full and the frames of the rest."""
    size = chunk_seconds * RATE
    rest = F.pmod(samples.cast("long"), F.lit(size))
    return div(samples, size) * (chunk_seconds * FRAMES_A_SECOND) + F.when(rest > 0, encoder_frames(mel_frames(rest))).otherwise(0)


def projected_tokens(frames: Column, stack: int = 4, boundaries: bool = False) -> Column:
    """Tokens of stacked frames, with a token on either side if boundaries."""
    return ceil_div(frames, stack) + (2 if boundaries else 0)


def example_length(before: Column, audio: Column, after: Column, target: Column) -> Column:
    """Tokens of a prompt with audio between its marks."""
    return before + 1 + audio + 1 + after + target


def dmel_frames(samples: Column, hop: int) -> Column:
    return div(samples, hop) + 1


def tokens_per_item(seq_len: Column, items: Column, stack: int = 4) -> Column:
    """The most tokens that one of several items may take (half-even rounding)."""
    return F.least(F.lit(round(LONGEST_SECONDS * FRAMES_A_SECOND / stack) + 2), div(seq_len, items))


def dummy_samples(budget: Column, stack: int = 4) -> Column:
    """The least samples whose tokens reach a budget."""
    frames = (budget - 3) * stack + 1
    return F.when(budget <= 2, F.lit(1).cast("long")).otherwise((frames * 2 - 1) * HOP)


def placeholder(token: int, length: Column) -> Column:
    """The audio token, length times; marks alone are refused."""
    return F.when(length > 2, F.array_repeat(F.lit(token), length.cast("int"))).otherwise(F.raise_error(F.lit("audio takes more than two tokens")).cast("array<int>"))


def at_rate(frames: Column, rate: Column) -> Column:
    """Samples at the common rate of frames at another."""
    return F.ceil(frames * F.lit(RATE) / rate).cast("long")


def chunk_count(seconds: Column) -> Column:
    """Chunks that cover so many seconds, at least one; what rounding adds opens no chunk."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(seconds / CHUNK_SECONDS - 1e-12).cast("long"))


def sidecar_samples(seconds: Column) -> Column:
    """Samples of a duration, rounded half to even."""
    return F.bround(seconds * RATE, 0).cast("long")


def contract(samples: Column, policy: str, max_seconds: int, seed: int, epoch: int, key: Column) -> Column:
    """What becomes of audio that may be too long: a struct of the crop, the samples used, the chunks and whether it is skipped."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy for long audio: {policy}")
    samples, most = samples.cast("long"), max_seconds * RATE
    start = {
        "center_crop": div(samples - most, 2),
        "random_crop": stable_bucket(seed, epoch, key, F.greatest(samples - most + 1, F.lit(1).cast("long"))),
    }.get(policy, F.lit(None).cast("long"))
    start = F.when(samples > most, start)
    used = F.when(start.isNotNull(), F.lit(most).cast("long")).otherwise(samples)
    chunked = policy == "chunk_pad"
    return F.struct(
        F.when(start.isNotNull(), F.lit(policy)).alias("crop_policy"),
        start.alias("crop_start"),
        used.alias("used_samples"),
        (ceil_div(samples, most) if chunked else F.lit(None).cast("long")).alias("chunk_count"),
        ((samples > most) & F.lit(policy == "skip")).alias("skipped"),
    )


def streaminfo(header: Column) -> Column:
    """rate, channels and samples of a FLAC header (its first 42 bytes); null where it isn't one."""

    def number(at: int, n: int) -> Column:
        return F.conv(F.hex(F.substring(header, at, n)), 16, 10).cast("long")

    packed_high, packed_low = number(19, 4), number(23, 4)  # rate 20, channels 3, depth 5 and samples 36 bits
    sound = (F.length(header) >= 42) & (F.substring(header, 1, 4) == F.lit(b"fLaC")) & (F.pmod(number(5, 1), F.lit(128)) == 0) & (number(6, 3) == 34)
    rate = F.shiftrightunsigned(packed_high, 12)
    channels = F.shiftrightunsigned(packed_high, 9).bitwiseAND(F.lit(7)) + 1
    samples = packed_high.bitwiseAND(F.lit(15)) * F.lit(1 << 32) + packed_low
    return F.when(sound, F.struct(rate.alias("rate"), channels.alias("channels"), samples.alias("samples")))


def exact_source(header_samples: Column, probed_samples: Column) -> Column:
    """Where an exact count comes from: the header, a probe of the file, or an empty file."""

    def sound(n: Column) -> Column:
        return F.coalesce((n > 0) & (n < MOST_SAMPLES), F.lit(False))

    return F.when(sound(header_samples), "flac_streaminfo").when(sound(probed_samples), "libsndfile_header").otherwise("flac_empty")


def chunks(waveform: Column, size: int) -> Column:
    """Chunks of a waveform, the last one short; an empty or infinite waveform is refused."""
    cut = F.transform(F.sequence(F.lit(0), ceil_div(F.size(waveform), size).cast("int") - 1), lambda k: F.slice(waveform, k * size + 1, size))
    return F.when((F.size(waveform) > 0) & all_finite(waveform), cut).otherwise(F.raise_error(F.lit("a waveform holds finite samples")).cast("array<array<double>>"))


def stacked(values: Column, factor: int) -> Column:
    """Runs of factor values, the last one filled with zeros."""
    n = ceil_div(F.size(values), factor).cast("int")
    full = F.concat(values, F.array_repeat(F.lit(0.0), n * factor - F.size(values)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.slice(full, k * factor + 1, factor))).otherwise(F.array().cast("array<array<double>>"))


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def raw_audio_fault(waveform: Column, rate: Column, max_seconds: int) -> Column:
    """What is wrong with a waveform, or null."""
    return (
        F.when(rate != RATE, "sample_rate")
        .when(F.coalesce(F.size(waveform), F.lit(0)) <= 0, "empty")
        .when(F.size(waveform) > max_seconds * RATE, "too_long")
        .when(~all_finite(waveform), "not_finite")
    )


def feature_fault(chunk_lengths: Column, feature_length: Column) -> Column:
    """What is wrong with features in chunks, or null."""
    total = F.aggregate(chunk_lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(chunk_lengths) <= 0, "no_chunks").when(F.exists(chunk_lengths, lambda x: x <= 0), "empty_chunk").when(total != feature_length, "length_mismatch")
