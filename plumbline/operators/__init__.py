"""DataFrame-to-DataFrame operators. Sizes are never assumed: joins carry no
broadcast hint unless the side is a literal frame of fixed length, so that table
statistics and adaptive execution choose the strategy."""
