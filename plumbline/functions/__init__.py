from .columns import (  # noqa: F401
    bad_record_len, band, blank_to_null, date_key, email_ok, exact_round, flag_in, guarded_int, is_count, outside_quotes,
    map_values, month_label, parse_any, rebuild_record, safe_ratio, standardize_text, title_case,
    truncate_text, weighted_score, zero_fill, public_columns, record_has_token, first_token,
)
