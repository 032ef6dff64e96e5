"""The sample files of the package, by the name the tests have for them."""

from tagquarry.plans.samples import *  # noqa: F403
