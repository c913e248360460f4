from blendspark.plans import distances, files, inputs, models, tables, texts, web  # noqa: F401
from blendspark.plans.registry import ORACLES, QUERIES  # noqa: F401
