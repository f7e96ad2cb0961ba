"""DataFrame-to-DataFrame operators over notes, chunks, edges and rankings."""
