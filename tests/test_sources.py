"""Files in and out."""

import gzip
import io
import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmura.sources import audio, tables


def test_tables(spark, tmp_path):
    text = 'Col1,Col2,filePath,Number\n10,foo,a,100.4\n20,"bar, x",b,200.4\n30,,c,NaN\n'
    (tmp_path / "t.csv").write_text(text)
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    for name in ("t.csv", "t.csv.gz"):
        got = tables.read_table(spark, str(tmp_path / name)).collect()
        assert [r["Col1"] for r in got] == [10, 20, 30] and got[1]["Col2"] == "bar, x" and got[2]["Number"] is None
    df = tables.read_table(spark, str(tmp_path / "t.csv"))
    for kind in ("feather", "parquet", "csv", "csv.gz"):
        path = str(tmp_path / f"out.{kind}")
        tables.write_table(df, path)
        back = tables.read_table(spark, path)
        assert back.columns == df.columns and back.count() == 3
    only = tables.read_table(spark, str(tmp_path / "out.feather")).select("Number")
    assert sorted(r[0] for r in only.where("Number IS NOT NULL").collect()) == [100.4, 200.4]
    assert tables.read_table(spark, str(tmp_path / "t.csv"), rows=2).count() == 2
    assert dict(tables.read_table(spark, str(tmp_path / "t.csv"), types={"Col1": "double", 3: "string"}).dtypes)["Col1"] == "double"
    for bad in ({"none": "int"}, {9: "int"}):
        with pytest.raises(ValueError):
            tables.read_table(spark, str(tmp_path / "t.csv"), types=bad)
    with pytest.raises(TypeError):
        tables.file_type("x.txt")
    assert next(tables.iterate(df)) == df.columns


def test_exports_and_documents(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / f"a_Parameters_{i}.txt").write_text(f"Filename\tFBak15dB  \nx-Myca-{i}.wav\t1.5\n")
    got = tables.read_exports(spark, str(tmp_path))
    assert got.columns == ["Filename", "FBak15dB"] and got.count() == 2
    doc = {"id": "f1", "annotated": True, "issues": False, "duration": 1.0, "annotation": [{"class": " Myotis x ", "event": "Echo", "start_time": 0.1, "end_time": 0.2, "low_freq": 1, "high_freq": 2}]}
    (tmp_path / "docs.json").write_text(json.dumps([doc]))
    from murmura.operators import nested

    rows = nested.explode_annotations(nested.filter_annotations(tables.read_annotations(spark, str(tmp_path / "docs.json"), "/x/"), to_genus=True))
    assert rows.first()["class"] == "Myotis"


def test_lists(spark, tmp_path):
    for n in ("a_2024-01-02T03_04_05.wav", "a_2025-01-02T03_04_05.WAV", "b.txt"):
        (tmp_path / n).write_bytes(b"x")
    listing = tables.list_files(spark, str(tmp_path))
    assert listing.count() == 2
    assert tables.files_by_timestamp(listing, latest=True).first()["stamp"].startswith("2025")
    assert tables.numbered_paths("d", "m", [1, 12], ".csv", 3) == ["d/m001.csv", "d/m012.csv"]


def wav(samples, rate=256000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((samples * 32767).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark, tmp_path):
    t = np.arange(25600) / 256000
    (tmp_path / "a.wav").write_bytes(wav(np.sin(2 * np.pi * 40000 * t) * 0.5))
    settings = audio.SpectrogramSettings(scale="none", denoise=False)
    row = audio.spectrograms(audio.recordings(spark, str(tmp_path)), settings).first()
    s = np.array(row["cells"]).reshape(row["rows"], row["cols"])
    assert abs((len(s) - s.sum(axis=1).argmax()) / settings.window + settings.low - 40000) < 1500
    with pytest.raises(ValueError):
        audio.decode(wav(np.zeros(8), channels=2))
    assert audio.chunks(5.0, 2.0) == [(0.0, 2.0), (2.0, 4.0), (4.0, 5.0)]

    def load():
        import pandas as pd

        return lambda x, rate: pd.DataFrame({"start_time": [0.01], "end_time": [0.02]})

    got = audio.detect(audio.recordings(spark, str(tmp_path)), load, "start_time double, end_time double", 0.05)
    assert sorted(round(r["start_time"], 3) for r in got.collect()) == [0.01, 0.06]
    feats = audio.call_features(s, [{"start_time": 0.01, "end_time": 0.05, "low_freq": 30000, "high_freq": 50000}], settings, 256000)
    assert abs(feats[0]["max_power"] - 40000) < 1500
    assert audio.heatmap((5, 5), [(2, 2)], 1.0)[2, 2] == 1


def test_stream(spark, tmp_path):
    from murmura.streaming import minute_activity, stream_exports

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x_Parameters_1.txt").write_text("Filename\tt\na\t2024-01-01 00:00:10\nb\t2024-01-01 00:00:20\n")
    stream = stream_exports(spark, str(tmp_path / "in"), "Filename string, t timestamp")
    q = minute_activity(stream, "t").writeStream.outputMode("complete").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("activity").select(F.sum("n")).first()[0] == 2


def test_wav_there_and_back():
    import numpy as np

    from murmura.sources import audio

    x = np.sin(np.linspace(0, 50, 1000)) * 1.2
    rate, back = audio.decode(audio.encode(8000, x))
    assert rate == 8000 and np.abs(back - np.clip(x, -1, 1)).max() < 1e-4
