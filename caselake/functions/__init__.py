from .dates import (  # noqa: F401
    date_attributes, date_from_id, date_id, is_timeline_date, month_id, province_date, strict_date, timeline_date,
    tolerant_date,
)
from .numbers import (  # noqa: F401
    clamp_negative, clean_decimal_text, clean_integer_text, dotted_thousands, first_digit_run, floor_div,
    half_up_2, tolerant_count, tolerant_number,
)
from .ratios import (  # noqa: F401
    fill_ratio, guarded_trend, hundredths, mean_of_rates, percent, percent_of_sums,
)
from .text import (  # noqa: F401
    NBSP, accent_pairs, clean_place_name, drop_province_suffix, fold_accents, null_if_missing_word,
    place_key, place_name_key, strip,
)
