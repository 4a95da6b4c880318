"""Event streams: state changes, rates, latest states; each as a batch and as a stream."""
