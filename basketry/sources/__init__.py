from basketry.sources.star import Star, STAR_TABLES
from basketry.sources.files import read_star, write_star, write_result
from basketry.sources.testdata import star_from_testdata

__all__ = ["Star", "STAR_TABLES", "read_star", "write_star", "write_result",
           "star_from_testdata"]
