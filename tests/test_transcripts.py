"""Files that grow, are cut and are written anew between triggers."""

import os

from tidelog.sources import transcripts


def test_lines_are_read_once(spark, tmp_path, monkeypatch):
    folder, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    os.mkdir(folder)

    def put(name, text, mode="a"):
        with open(f"{folder}/{name}", mode) as file:
            file.write(text)

    def drain():
        rows = transcripts.transcript_lines(spark, folder)
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted((os.path.basename(r.file), r.offset, r.line) for r in spark.read.parquet(out).collect())

    put("a.jsonl", "one\ntwo\nunfin")
    put("b.jsonl", "")
    put("c.txt", "another kind\n")
    want = [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two")]
    assert drain() == want
    put("a.jsonl", "ished\n\nfo")
    put("b.jsonl", "ä\n" + "long" * 40_000 + "\n")
    want += [("a.jsonl", 8, "unfinished"), ("a.jsonl", 19, ""), ("b.jsonl", 0, "ä"), ("b.jsonl", 3, "long" * 40_000)]
    assert drain() == sorted(want)
    assert drain() == sorted(want)
    put("a.jsonl", "new\n", "w")  # shorter: from its beginning
    put("d.jsonl", "no end")
    want += [("a.jsonl", 0, "new")]
    assert drain() == sorted(want)
    put("a.jsonl", "er\n")
    os.remove(f"{folder}/b.jsonl")
    want += [("a.jsonl", 4, "er")]
    assert drain() == sorted(want)


def test_pieces_end_at_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(transcripts, "PIECE", 10)
    monkeypatch.setattr(transcripts, "STEP", 4)
    text = "aaa\nbbbbbbbbbbbbbbbbbbb\nc\n\ndd\ne" * 5 + "\nrest"
    with open(f"{tmp_path}/x.jsonl", "w") as file:
        file.write(text)
    reader = transcripts._Reader(str(tmp_path), ".jsonl")
    pieces = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(pieces) > 5 and all(a.end == b.start for a, b in zip(pieces, pieces[1:]))
    got = [line for p in pieces for _, _, line in reader.read(p)]
    assert got == text.split("\n")[:-1]
