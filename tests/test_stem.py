"""Porter stems of the published examples."""

import pytest

from statloom.functions.stem import porter

PAIRS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "radically": "radic", "triplicate": "triplic", "hopefulness": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "adoption": "adopt",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controlling": "control", "generalizations": "gener", "oscillators": "oscil",
}


@pytest.mark.parametrize("word", sorted(PAIRS))
def test_stem(word):
    assert porter(word) == PAIRS[word]
