from .delimited import read_columns_csv, read_tsv, sniff_encoding, write_csv_snapshot  # noqa: F401
from .html import (  # noqa: F401
    html_cells, html_list_items, locality_rows, positional_rows, table_with_words,
)
from .joblog import JobLog  # noqa: F401
from .landing import land_daily, recent_days  # noqa: F401
from .store import TableStore  # noqa: F401
