from .clean import (  # noqa: F401
    clean_daily, deduplicate, drop_aggregate_rows, flag_rows, keep_last, quality_counts, bad_date_samples,
)
from .keys import lookup_key, number_keys, with_new_keys  # noqa: F401
from .latest import latest_known_value, latest_row_per_key, last_non_null  # noqa: F401
from .merge import evolve, insert_if_absent, upsert, upsert_columns  # noqa: F401
from .audit import duplicate_keys, orphan_rows  # noqa: F401
from .series import chunk_downsample, cumulative_to_daily, downsample_step, newest_rows, rolling_sums  # noqa: F401
from .ranking import five_classes, rank_top, share_of_max, top_n, top_n_versus_rest  # noqa: F401
from .places import coordinates, lookup_places, polygon_vertices, vertex_centre  # noqa: F401
from .routing import route_counts, route_messages  # noqa: F401
