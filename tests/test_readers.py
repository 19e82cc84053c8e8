"""Scans that need files: seed-product JSON arrays (S2) and image intake."""

import base64
import json

from pricelens.sources import readers


def test_seed_products_array_file(spark, tmp_path):
    rows = [{"title": "iPhone 13 Pro", "price": 13000.0, "category": "iphone 13",
             "image_url": "https://a/img.jpg", "product_url": "https://a/p"},
            {"title": "Headphones X", "price": 40, "category": "headphones", "image_url": "", "product_url": "https://b"}]
    (tmp_path / "seed.json").write_text(json.dumps(rows, indent=2))
    got = readers.read_seed_products(spark, str(tmp_path / "seed.json")).collect()
    assert [(r["title"], r["price"]) for r in got] == [("iPhone 13 Pro", 13000.0), ("Headphones X", 40.0)]


def test_image_intake(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"\x00" * 20
    (tmp_path / "a.png").write_bytes(png)
    (tmp_path / "b.JPG").write_bytes(b"\xff\xd8\xff\xe0" + b"\x00" * 10)
    (tmp_path / "c.gif").write_bytes(b"not a gif")
    (tmp_path / "d.txt").write_bytes(b"hello")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in readers.intake_images(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.JPG", "c.gif"}
    assert got["a.png"]["valid_header"] and got["a.png"]["base64"] == base64.b64encode(png).decode()
    assert got["b.JPG"]["valid_header"] and not got["c.gif"]["valid_header"] and got["c.gif"]["base64"] is None
