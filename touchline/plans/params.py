"""Fixed parameters of the registered queries (the driver data lives in
January 2024 for the event clock and 1995–2001 for the orders clock)."""

APP = "services"
DAY_FROM = "2024-01-08"          # event/touch window (inclusive days)
DAY_TO = "2024-01-20"
SPEND_FROM = "2024-01-01"        # ad spend window
SPEND_TO = "2024-01-30"
ORDERS_FROM = "1997-01-01"       # orders-clock window for repeat / cohort metrics
ORDERS_TO = "1998-12-31"
LTV_FROM = "1995-01-01"          # wide window covering orders and spend
LTV_TO = "2024-01-31"
LOOKBACK_DAYS = 7
NOW = "2024-01-31 00:00:00"
FUNNEL_STEPS = ["el_first_open", "el_signup", "el_add_to_cart", "charged"]
