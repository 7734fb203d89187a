from .families import (
    NESTED, NUMERIC, OTHER, STRING, TEMPORAL, ColumnSpec, column_specs,
    quote, type_family,
)
from .names import (
    DEFAULT_NAME_RULE, STAR_NAME_RULE, NameRule, entity_name, name_rule,
)
from .exprs import ratio, ratio0, sql_credit_card, sql_double, sql_id, sql_matches, sql_str
