"""Operator 5: SentencePiece encoding and decoding by Aho-Corasick and Viterbi.

The automaton over all pieces reports, at each character, every piece that ends
there (its output links); the best score of each position is relaxed once from
left to right. Ties go to the longer last piece. Characters that no piece covers, and a literal
U+2581, become byte pieces, so decoding returns the text itself. Spaces are
U+2581 and one is put in front of a non-empty text; nothing else is normalised.
Pieces have U+2581 only at their front, so runs that begin with it are encoded
apart and remembered in a bounded cache; this changes no result.

Null and empty texts have no ids; decoding gives the empty text. Input columns
named ids or decoded, or beginning with ``_sv_``, are replaced. Rows are coded
one by one, so repeats agree.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import parts, table, without

MARK, RUN = "▁", re.compile(" *[^ ]+| +")
CACHE = 300_000


class Codec:
    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.piece = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if sp.is_byte(i)}
        value = {i: bytes((b,)) for b, i in self.bytes.items()}
        self.plain = [value.get(i) or p.replace(MARK, " ").encode() for i, p in enumerate(self.piece)]
        self.auto, low = ahocorasick.Automaton(), 0.0
        for i, p in enumerate(self.piece):
            if p and not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                if MARK in p.lstrip(MARK):
                    raise ValueError(f"piece {i} has a space inside")
                s = sp.get_score(i)
                low = min(low, s)
                self.auto.add_word(p.replace(MARK, " "), (len(p), s, i))
        self.auto.make_automaton()
        self.byte_score, self.known = low - 10.0, {}

    def _run(self, s: str) -> tuple[int, ...]:
        best, back = [0.0] + [-1e300] * len(s), [(0, ())] * (len(s) + 1)
        done = 0

        def bytes_until(end):
            nonlocal done
            while done < end:  # by bytes, after all pieces that end here were seen
                c = s[done].encode("utf-8", "surrogatepass")
                v = best[done] + self.byte_score * len(c)
                done += 1
                if v > best[done]:
                    best[done], back[done] = v, (1, tuple(self.bytes[x] for x in c))

        pending = []
        for end, (n, score, i) in self.auto.iter(s):
            if done < end:
                bytes_until(end)
            end += 1
            v = best[end - n] + score
            if v > best[end]:
                best[end], back[end] = v, (n, (i,))
        bytes_until(len(s))
        at = len(s)
        while at:
            n, ids = back[at]
            pending.append(ids)
            at -= n
        return tuple(x for ids in reversed(pending) for x in ids)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for run in RUN.findall(" " + text) if text else ():
            got = self.known.get(run)
            if got is None:
                got = self._run(run)
                if len(self.known) >= CACHE:
                    self.known.clear()
                if len(run) <= 64:
                    self.known[run] = got
            out.extend(got)
        return out

    def decode(self, ids) -> str:
        return b"".join(map(self.plain.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]


def encode_decode(docs: DataFrame, model_file: str) -> DataFrame:
    """docs plus ids and decoded."""

    def run(batches):
        codec = Codec(model_file)
        for b in batches:
            for part in parts(b):
                flat, at, decoded = array("i"), [0], []
                for t in part.column("text").to_pylist():
                    ids = codec.encode(t)
                    flat.extend(ids)
                    at.append(len(flat))
                    decoded.append(codec.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(flat, np.int32)))
                yield part.append_column("ids", lists).append_column("decoded", pa.array(decoded, pa.string()))

    docs = without(docs, "ids", "decoded")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType())), StructField("decoded", StringType())]))


def digest(coded: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip."""

    def run(batches):
        for b in batches:
            ids, at = b.column("ids").values.to_numpy().astype("<u4"), b.column("ids").offsets.to_pylist()
            same = pc.equal(b.column("text").fill_null(""), b.column("decoded"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(ids[x:y]) for x, y in zip(at, at[1:])], pa.int64()), same],
                                             ["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return coded.select("doc_id", "text", "ids", "decoded").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model")))
