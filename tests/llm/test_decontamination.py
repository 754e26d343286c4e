"""What a task is sent to look for benchmark items, and that it finds the same with it."""

import pickle
import random

import numpy as np
import pyarrow as pa

from activity_engine.llm import decontamination
from activity_engine.llm.words import cut


def test_items_travel_without_their_filters():
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    texts = [" ".join(word() for _ in range(n)).encode() for n in (1, 3, 9, 20, 40, 41)]
    items = decontamination.Items(np.arange(len(texts)), pa.array(texts, pa.binary()))
    sent = pickle.dumps(items)
    assert len(sent) < 1 << 20
    words = cut(pa.array([b"x y " + texts[3] + b" z", b"none of them", b" ".join(texts), b""], pa.binary()), lower=True)
    found = items.candidates(words)
    assert {(0, 3), *((2, i) for i in range(6))} <= {(doc, item) for doc, item, _ in found.tolist()}
    assert np.array_equal(pickle.loads(sent).candidates(words), found)
