"""DataFrame-to-DataFrame operators on tokens, commands, fonts, graphs and pixels."""
