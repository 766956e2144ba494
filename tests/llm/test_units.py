from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.units import KEPT_BYTES, UnitEncoder, id_column, text_slices

ODD = [None, "", " ", "  ", "a", "a ", " a", "a  b", "\n", "a\nb", "a \n b", " x 　 y", "x  y", "don't, it's!  we'll.", "\x1c a\x1c b", "a.\x85 b", "..., ab. cd, é. 123. 12a, a1.", "\t\tx  ", "end\n\n\n", "a \n", "z" * 5000 + ". q"]


@pytest.mark.parametrize("kept", [KEPT_BYTES, 200])
def test_units_are_what_the_library_gives_for_whole_texts(kept):
    """Runs of white space of every kind, punctuation, contractions; with room for all units or hardly any."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = UnitEncoder(lambda units: [e.ids for e in library.encode_batch_fast(units, add_special_tokens=False)], kept)
    rng = random.Random(2)
    alphabet = ["a", "é", "1", ".", " ", " ", "\n", " ", "'s", "\x1d", "​", "北", "!"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12))) for _ in range(1500)]
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        got = id_column(*encoder.encode(pa.array(part, pa.string()))).to_pylist()
        assert got == [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in part]
    assert [len(x) for x in encoder.encode(pa.array([], pa.string()))] == [0, 0]


def test_slices_hold_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n if n % 5 else None for n in range(60)])], names=["text"])
    parts = list(text_slices(batch, 0, most=100))
    assert pa.Table.from_batches(parts).to_pydict() == pa.Table.from_batches([batch]).to_pydict()
    assert len(parts) > 5 and all(len(p) == 1 or sum(len(x or "") for x in p.column(0).to_pylist()) <= 100 for p in parts)
