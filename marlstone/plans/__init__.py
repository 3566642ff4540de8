"""Query plans of the library's own operators; importing this package registers them."""

from marlstone.plans import aggregates, gates, kernels, ordered, planner, profiling, ranking, records, scalars, sets, similarity, spread, stateful

__all__ = ["aggregates", "gates", "kernels", "ordered", "planner", "profiling", "ranking", "records", "scalars", "sets", "similarity", "spread", "stateful"]
