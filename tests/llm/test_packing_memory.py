"""What a worker holds between the tasks of packing."""

from cellwright.llm import packing


def test_worker_remembers_no_parts_after_a_task(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": staticmethod(lambda: 0)}))}))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words, some more words; some words"] * 2})
    run = packing._packer(packing.WINDOW, packing.END, None, False)
    once, again = (sum((b.to_pylist() for b in run(iter([batch]))), []) for _ in range(2))
    assert once == again
    held = packing.encoder()
    for parts in (held.marks, held.first, held.spaced):
        assert not parts and not parts.elder and not any(parts.met)
