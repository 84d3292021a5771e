"""Places to cut of the packing operator."""

import numpy as np

from wayframe.llm import packing


def test_every_sentence_end_is_a_place_to_cut():
    """The last sentence end in reach is taken though one out of reach follows it within 64 ids."""
    packer = packing.Packer(230, packing.Costs(), 0)
    packer.docs = [(1, 0, 400)]
    packer.ids, packer.ends_sentence = np.zeros(400, np.int32), np.zeros(400, bool)
    packer.ends_sentence[[200, 250]] = True
    assert packer._cuts(0, 400, True) == [201, 400]
