"""Fill-in-the-middle: a text is cut at two places and its parts are put in another order.

The bytes of a batch of texts get one bit each: 1 where a unit (a line, or a
code point) ends.  The bits are packed, and a directory holds the number of set
bits before each block.  The difference of two ranks is a text's number of units n, and
``select`` finds the byte at which the k-th unit ends; a second bit vector,
of the first bytes of code points, counts code points between cuts.  Both cuts
and the order come from seeded digests of the key, so any rerun gives the same.

Cases: null texts count as empty, and empty texts stay plain, as do texts that
hold a sentinel; a null key is an empty key; texts of any length are cut whole;
equal rows get equal results; an empty table gives an empty one; columns of any
name may stand beside (those named like a result are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_arrow, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Words of 64 bits in a block of the directory.
WORDS = 8
BLOCK = 64 * WORDS
RESULT = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}


class Bits:
    """A packed bit vector that counts and finds its set bits."""

    def __init__(self, marks: np.ndarray) -> None:
        packed = np.packbits(marks, bitorder="little")
        words = np.zeros((len(packed) // (8 * WORDS) + 1) * WORDS, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.blocks = words.reshape(-1, WORDS)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks).sum(1, dtype=np.int64))])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        block, rest = np.divmod(np.asarray(at, np.int64), BLOCK)
        bits = np.clip(rest[:, None] - np.arange(0, BLOCK, 64), 0, 64).astype(np.uint64)
        mask = np.where(bits == 64, ~np.uint64(0), (np.uint64(1) << (bits % np.uint64(64))) - np.uint64(1))
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask).sum(1, dtype=np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit, from 0."""
        k = np.asarray(k, np.int64)
        block = np.searchsorted(self.before, k, "right") - 1
        ends = np.bitwise_count(self.blocks[block]).cumsum(1, dtype=np.int64)
        rest = k - self.before[block]
        word = (ends <= rest[:, None]).sum(1)
        rest -= np.where(word > 0, np.take_along_axis(ends, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
        bits = np.unpackbits(self.blocks[block, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * BLOCK + word * 64 + (bits.cumsum(1) > rest[:, None]).argmax(1)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end, and where each begins and the last one ends; nulls are empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def unit_ends(data: np.ndarray, offsets: np.ndarray, unit: str) -> np.ndarray:
    """True at the last byte of each unit."""
    if unit == "line":
        marks = data == 10
    else:
        marks = np.ones(len(data), bool)
        marks[:-1] = data[1:] >> 6 != 2
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    marks[ends - 1] = True
    return marks


def cuts(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n of each text, and the bytes where its prefix and its middle end."""
    bits = Bits(unit_ends(data, offsets, unit))
    ranks = bits.rank(offsets)
    n = np.diff(ranks)
    drawn = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    ends = [np.where(k > 0, bits.select(np.maximum(ranks[:-1] + k - 1, 0)) + 1, offsets[:-1]) if bits.before[-1] else offsets[:-1] for k in drawn]
    return n, *ends


def split(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] | None = None, seed: int = 7, unit: str = "line", fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """The columns ``keep`` (all, if None) with n, form (plain, psm or spm), prefix_chars, middle_chars and output."""
    if unit not in ("line", "char"):
        raise ValueError(f"no such unit: {unit}")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in RESULT]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 0):
            texts = part.column(0)
            data, offsets = flat(texts)
            h1, h2, h3, h4 = (part.column(k).to_numpy() for k in range(1, 5))
            n, first, second = cuts(data, offsets, h1, h2, unit)
            held = pc.or_(pc.or_(pc.match_substring(texts, PREFIX), pc.match_substring(texts, SUFFIX)), pc.match_substring(texts, MIDDLE))
            plain = pc.fill_null(held, False).to_numpy(zero_copy_only=False) | (n == 0) | (h3 % 100 >= fim_percent)
            spm = h4 % 100 < spm_percent
            letters = Bits(data >> 6 != 2)
            starts, one, two = (letters.rank(x) for x in (offsets[:-1], first, second))
            raw, out = data.tobytes(), []
            for a, b, c, d, p, s in zip(offsets[:-1].tolist(), first.tolist(), second.tolist(), offsets[1:].tolist(), plain.tolist(), spm.tolist(), strict=True):
                if p:
                    out.append(raw[a:d])
                elif s:
                    out.append(b"".join((b"<S>", raw[c:d], b"<P>", raw[a:b], b"<M>", raw[b:c])))
                else:
                    out.append(b"".join((b"<P>", raw[a:b], b"<S>", raw[c:d], b"<M>", raw[b:c])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            counts = [pa.array(x, pa.int64(), mask=plain) for x in (one - starts, two - one)]
            found = [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *counts, pa.array(out, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(5, 5 + len(kept))), *found], [*kept, *RESULT])

    schema = StructType([df.schema[c] for c in kept] + [StructField(c, t) for c, t in RESULT.items()])
    asked = df.select(F.col(f"`{text}`").alias("_text"), *drawn, *(F.col(f"`{c}`") for c in kept))
    return map_arrow(asked, run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone.

    The texts of psm and spm hold no sentinel, and none can arise where parts meet, so the first occurrence counts.
    """
    body = F.substring(output, F.lit(4), F.length(output))

    def ordered(second: str) -> Column:
        one = F.substring_index(body, second, 1)
        after = F.substring(body, F.length(one) + 4, F.length(body))
        two = F.substring_index(after, MIDDLE, 1)
        middle = F.substring(after, F.length(two) + 4, F.length(after))
        return F.concat(one, middle, two) if second == SUFFIX else F.concat(two, middle, one)

    return F.when(form == "psm", ordered(SUFFIX)).when(form == "spm", ordered(PREFIX)).otherwise(output)


ORACLE = """
with d as (select doc_id, coalesce(text, '') as t, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
l as (select *, string_split(t, chr(10)) as lines, cast(case when t = '' then 0 else length(t) - length(replace(t, chr(10), '')) + if(right(t, 1) = chr(10), 0, 1) end as bigint) as n,
  [cast(cast('0x' || substr(h, 8 * k + 1, 8) as ubigint) as bigint) for k in range(4)] as r from d),
k as (select *, least(r[1] % (n + 1), r[2] % (n + 1)) as k1, greatest(r[1] % (n + 1), r[2] % (n + 1)) as k2 from l),
c as (select *,
  case when k1 = 0 then 0 when k1 = n then length(t) else length(array_to_string(list_slice(lines, 1, k1), chr(10))) + 1 end as c1,
  case when k2 = 0 then 0 when k2 = n then length(t) else length(array_to_string(list_slice(lines, 1, k2), chr(10))) + 1 end as c2,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or r[3] % 100 >= 100 then 'plain' when r[4] % 100 < 50 then 'spm' else 'psm' end as form from k),
p as (select *, substr(t, 1, c1) as a, substr(t, c1 + 1, c2 - c1) as b, substr(t, c2 + 1) as s from c)
select doc_id, n, form, cast(if(form = 'plain', null, c1) as bigint) as prefix_chars, cast(if(form = 'plain', null, c2 - c1) as bigint) as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || a || '<S>' || s || '<M>' || b else '<S>' || s || '<P>' || a || '<M>' || b end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""
