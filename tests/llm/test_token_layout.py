"""The ids of an encoder's texts, laid end to end, against the tokenizer itself."""

import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from pigmenta.llm import tokens
from pigmenta.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(Path(tokenizer_path()).read_text(encoding="utf-8"))


@pytest.mark.parametrize("texts", [[], [""], ["", ""], ["one"], ["", "a b, c.\nd", "", " x  y "]])
@pytest.mark.parametrize("end", [b"", b"\0\0\0\0"])
def test_texts_without_ids_and_no_texts(encoder, texts, end):
    ids, counts = encoder.encode_array(pa.array(texts, pa.string()), True, end)
    want = [[*encoder.tokenizer.encode(t, add_special_tokens=False).ids, *[0] * (len(end) // 4)] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_ids_are_laid_out_without_an_index_of_each(encoder):
    """An index of 64 bits for every id took several times the ids."""
    long = pa.array(["  ".join(["q9 zx"] * 20_000)] * 10)
    encoder.encode_array(long, True, b"\0\0\0\0")
    tracemalloc.start()
    ids, _ = encoder.encode_array(long, True, b"\0\0\0\0")
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(len(ids), most, most / ids.nbytes)
    assert most < 8 * ids.nbytes


def test_pieces_are_runs_of_a_class(encoder):
    rng = random.Random(7)
    parts = ["a", "Bc", "é", "ß", "ñ", "×", "÷", "ª", "²", "À", "ÿ", "s", "'s", "'", "1", "23", ".", "**", "$", "&", "_", " ", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "日", "ж", "é", "🙂", "\x00", "\xa0", "<|", "<|endoftext|>", ""]
    texts = ["".join(rng.choices(parts[: rng.choice([12, 28, len(parts)])], k=rng.randint(0, 14))) for _ in range(20_000)]
    for odd in (texts, [t for t in texts if not tokens._ODD[np.frombuffer(t.encode(), dtype=np.uint8)].any()]):
        ids, counts = encoder.encode_array(pa.array(odd), True, b"\0\0\0\0", odd is texts)
        want = [[*e.ids, 0] for e in encoder.tokenizer.encode_batch(odd, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_blank_lines_and_indents_send_no_text_to_the_tokenizer_whole(encoder, monkeypatch):
    whole, plain = [], encoder._plain
    monkeypatch.setattr(encoder, "_plain", lambda text: whole.append(text) or plain(text))
    texts = [f"  Title {i}\n\nsome  words,\n    {i}. an indent ***\n" for i in range(300)]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in encoder.encode(texts)] == want
    assert not whole


def test_without_a_byte_that_no_merge_has_runs_go_to_the_tokenizer_alone(encoder):
    other = tokens.Encoder(Path(tokenizer_path()).read_text(encoding="utf-8"))
    assert other.gap is not None
    other.gap = None
    texts = ["Ab12 été,\n\n  x's 3×4 ", "one"]
    assert other.encode(texts) == encoder.encode(texts)
