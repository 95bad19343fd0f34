"""Sizes of the boosted models."""

from flickpulse.operators import models as M


def test_boosted_models_have_the_rounds_of_the_reference(spark):
    for name, rounds in (("gbt", 300), ("gbt_band", 150)):
        stage = M.regressor(name)
        assert (stage.getMaxIter(), stage.getStepSize(), stage.getMaxDepth()) == (rounds, 0.05, 3)
