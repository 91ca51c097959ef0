"""Nothing here is a stream by nature; a stream of pages is a series of batches."""
