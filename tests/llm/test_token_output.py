import base64

import numpy as np
import pytest
import tiktoken
import zstandard
from cases import ODD, clashing, empty, lettered, odd, rows

from lodestone.llm.token_output import Encoder, Params, TokenFile, decode, token_files, write_files

P = Params("/opt/tokenizers/byte_bpe_50k.tiktoken")
RANKS = open(P.tokenizer, "rb").read()
DIRECT = tiktoken.Encoding("t", pat_str=P.pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}, special_tokens={})


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a b", "a  b", "a \n b", "a\n b", "a b ", "it's 3 o'clock, don't!", "x  y", "x  y", "x　 y z", "😀 é 漢 字", "a\tb c\r\nd", "a\x1c b"])
def test_ids_are_the_tokenizers(text):
    encode = Encoder(RANKS, P)
    for _ in range(2):
        assert np.frombuffer(encode(text), "<u2").tolist() == [*DIRECT.encode_ordinary(text), P.end]


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    files = token_files(docs, Params(P.tokenizer, file_bytes=100_000))
    want = {r.doc_id: r.text for r in docs.collect()}
    assert files.count() > 2
    got = {r.doc_id: r.tokens for r in decode(files).collect()}
    assert got.keys() == want.keys()
    for k, t in got.items():
        assert t[-1] == P.end and t[:-1] == DIRECT.encode_ordinary(want[k]) and DIRECT.decode(t[:-1]) == want[k]


def test_reader_reads_only_what_is_asked(spark, sf, tmp_path):
    files = token_files(spark.read.parquet(f"{sf}/documents.parquet").coalesce(1), P)
    row = files.first()
    reads = []
    f = TokenFile(lambda at, n: (reads.append((at, n)), row.data[at : at + n])[1], len(row.data))
    before = len(reads)
    (found,) = f.documents([row.doc_ids[7]])
    assert found[0] == row.doc_ids[7] and reads[before:] == [(int(f.at[7]), int(f.sizes[7]))]
    # Any zstandard reader gets the whole.
    whole = b"".join(zstandard.ZstdDecompressor().decompress(row.data[f.at[k] : f.at[k + 1]], max_output_size=int(f.raw[k]) + 1) for k in range(len(f.doc_ids)))
    assert zstandard.ZstdDecompressor().stream_reader(row.data, read_across_frames=True).read() == whole
    write_files(files, tmp_path.as_uri())
    g = TokenFile.open((tmp_path / row.file).as_uri())
    assert g.frame(7).tolist() == found[1].tolist() and [x.name for x in tmp_path.iterdir()] == [row.file]
    broken = bytearray(row.data)
    broken[int(f.at[8]) - 1] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        TokenFile.of(bytes(broken)).frame(7)
    assert TokenFile.of(bytes(broken)).frame(8).tolist() == f.frame(8).tolist()


def test_odd_rows(spark, tmp_path):
    files = token_files(odd(spark).coalesce(1), P)
    assert sorted(files.first().doc_ids) == sorted(r[0] for r in ODD if r[0] is not None)
    got = rows(decode(files))
    assert [t for i, t in got if i in (1, 2)] == [[P.end], [P.end]] and len([1 for i, _ in got if i == 5]) == 2
    assert rows(decode(token_files(clashing(odd(spark)).coalesce(1), P))) == got
    assert rows(token_files(empty(spark), P)) == []
    assert rows(decode(files, [None, 12345])) == [] and rows(decode(files.limit(0))) == [] and len(rows(decode(files, [5]))) == 2
    with pytest.raises(ValueError, match="whole number"):
        token_files(lettered(odd(spark)), P)
    write_files(files.limit(0), (tmp_path / "none").as_uri())
    assert not (tmp_path / "none").exists() or not list((tmp_path / "none").iterdir())
