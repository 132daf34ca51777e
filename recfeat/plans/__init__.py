"""Plans: the library's operators as queries over the given tables."""

from recfeat.plans import extended, extra, features, final, interests, metrics, models, more, products, profiles, recall, rerank, samples, streams  # noqa: F401
