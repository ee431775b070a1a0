"""The sieve of :mod:`tallyfold.plans.sieve`, under the name that the operators here use."""

from tallyfold.plans.sieve import BITS, BUCKETS, apart, may, split

__all__ = ["BITS", "BUCKETS", "apart", "may", "split"]
