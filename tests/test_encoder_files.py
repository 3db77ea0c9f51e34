import random
import zipfile

import numpy as np

from kinweave.operators import encoder
from kinweave.sources import files


def records(n, seed):
    """Names and addresses, and copies with words dropped, cut, and swapped."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("park", "green", "steel", "blue", "north", "river", "gold") for b in ("er", "son", "wood", "field", "land", "ton")]
    out = []
    for _ in range(n):
        name, address = [rng.choice(words) for _ in range(3)], [str(rng.randint(1, 300)), rng.choice(words), "street", rng.choice(words)]
        worn = [w[: max(3, len(w) - rng.randint(0, 2))] for w in name if rng.random() > 0.15]
        rng.shuffle(worn)
        place = [w for w in address if rng.random() > 0.25]
        out.append((" ".join(name), " ".join(address), " ".join(worn), " ".join(place)))
    return out


def recall(model, rows):
    q, t = (model.encode([r[i] for r in rows], [r[i + 1] for r in rows]) for i in (0, 2))
    return float(((q @ t.T).argmax(1) == np.arange(len(rows))).mean())


def test_training_brings_links_together(spark):
    rows, held = records(1500, 1), records(300, 2)
    pairs = spark.createDataFrame([(*r, "US") for r in rows], "q_name string, q_address string, t_name string, t_address string, country string")
    options = {"dim": 32, "bag": 32, "buckets": 1 << 12}
    before, after = (encoder.fit_encoder(pairs, epochs=k, **options) for k in (0, 6))
    assert recall(after, held) > recall(before, held) + 0.05 and recall(after, held) > 0.8
    again = encoder.fit_encoder(pairs.repartition(7), epochs=6, **options)
    assert np.allclose(after.layer, again.layer)
    out = pairs.limit(3).select(encoder.encode(after)("q_name", "q_address").alias("v")).collect()
    assert all(abs(np.linalg.norm(r["v"]) - 1) < 1e-5 for r in out)
    empty = after.encode([None, ""], ["", None])
    assert np.allclose(empty[0], empty[1]) and np.isfinite(empty).all()


def test_tokens_of_words_and_grams():
    row, bucket = encoder.tokens(["ab cd", "cd", "", None], 1 << 20)
    both = set(bucket[row == 0]) & set(bucket[row == 1])
    assert set(row) == {0, 1} and len(both) == 4  # ' cd', 'cd ', ' cd ' and the word


def test_files(tmp_path):
    box, root = tmp_path / "a.zip", tmp_path / "root"
    root.mkdir()
    (root / "x.py").write_text("1")
    (root / "m.joblib").write_text("2")
    assert files.review_archive(str(root), str(box)) == ["x.py"] and zipfile.ZipFile(box).namelist() == ["x.py"]
    assert files.unpack_once(str(box), str(tmp_path / "out")) and not files.unpack_once(str(box), str(tmp_path / "out"))
    assert (tmp_path / "out" / "x.py").read_text() == "1"
    assert files.copy_in_parts(str(box), str(tmp_path / "b.zip"), 7) == box.stat().st_size and (tmp_path / "b.zip").read_bytes() == box.read_bytes()
    found = files.environment(str(tmp_path))
    assert found["cpus"] >= 1 and found["disk_free_bytes"] > 0 and found["memory_bytes"] > 0
