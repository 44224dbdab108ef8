"""Compositions: reporting views, page frames, validation ledger, the end-to-end job."""
