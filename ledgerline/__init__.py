"""ledgerline: investment-portfolio analytics as Spark jobs.

Broker transactions, fund prices and index levels are modelled as a star schema
(accounts, funds, calendar, transaction types, transactions), forward filled
with as-of joins to value every holding on every day, and rolled up into
monthly snapshots, Modified Dietz returns, trailing compounded returns and
Sharpe ratios, cost basis, contributions by financial year and rebased index
series. Everything is a ``DataFrame -> DataFrame`` function; Catalyst plans it.
"""

from ledgerline.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
