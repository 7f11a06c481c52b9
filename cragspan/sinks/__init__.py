"""Writers: every task writes whole files of its own rows to a shared folder."""
