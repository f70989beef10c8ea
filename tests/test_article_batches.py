"""Memory of the workers that read pages."""

import pyarrow as pa

from updatelens.sources import articles


def test_few_pages_are_held_at_once():
    """A large batch leaves in small ones, so the memory of a worker does not grow with the batch."""
    page = "<title>t</title><article>" + "word " * 50 + "</article>"
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(1000)), "url": ["u"] * 1000, "html": [page] * 999 + [None]})
    made = list(articles._read(iter([batch])))
    assert max(b.num_rows for b in made) < 100
    assert [i for b in made for i in b.column("page_id").to_pylist()] == list(range(1000))
    assert made[-1].column("title").to_pylist()[-1] is None and made[0].column("title")[0].as_py() == "t"
